"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if driver and executors are
    one process; on a cluster an error, for executors don't share their machines' folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession | None = None, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, where the session (by default the active one)
    has the default of ten times as many: whole texts are long, and a batch is held on both
    sides of the worker's pipe, and in Python several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = spark or SparkSession.getActiveSession()
    if spark and spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def _file_system(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage cut, executors may be lost. The
    table goes when the application ends, or earlier by `dropped`."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    files, path = _file_system(spark, at)
    files.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(at)
    back.weft_path = at
    return back


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of `kept` that nothing will read again."""
    for t in tables:
        files, path = _file_system(spark, t.weft_path)
        files.delete(path, True)
        files.cancelDeleteOnExit(path)
