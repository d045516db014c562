"""Pages as a stream: extraction, deduplication by content hash, checkpointed output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions import text
from weftline.operators import pages


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", files: int = 8) -> DataFrame:
    """Parquet files of raw pages as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def clean_stream(raw: DataFrame, least: int = 20, time: str | None = None, late: str = "1 day") -> DataFrame:
    """url, title, content and hash of each new content, the first to arrive of equals. With
    a time column the memory of hashes is bounded by the watermark."""
    x = raw.withColumn("x", pages.extract(F.col("html"), F.col("url")))
    rows = x.select("url", "x.title", "x.content", *([time] if time else [])).where(pages.enough_words(F.col("content"), least))
    rows = rows.withColumn("hash", text.content_hash(F.col("content")))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"]) if time else rows.dropDuplicates(["hash"])


def write_stream(df: DataFrame, out: str, checkpoint: str, form: str = "json") -> StreamingQuery:
    """Runs over what is there, then stops; a later run goes on from the checkpoint."""
    return df.writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
