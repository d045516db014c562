"""Reading and writing page indexes, seeds, state, hashes and logs."""

from __future__ import annotations

import json
import os
import uuid
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.tables import small_batches

PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "title", "path", "crawled_at", "citation", "tool", "text")]
    + [T.StructField("images", T.ArrayType(T.StringType())), T.StructField("screenshot", T.StringType()), T.StructField("screenshot_error", T.StringType())]
    + [T.StructField("pattern", T.StringType()), T.StructField("pattern_cluster_size", T.IntegerType()), T.StructField("is_sample", T.BooleanType())]
)


def read_pages(spark: SparkSession, paths: str | list[str], tag_source: bool = False) -> DataFrame:
    """Page rows of one or several JSON-lines files; blank lines are skipped. With tag_source,
    or where there are several, _source is the file each row comes from."""
    many = not isinstance(paths, str)
    df = spark.read.schema(PAGE).json(paths)
    return df.withColumn("_source", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0)) if tag_source or many else df


def write_pages(rows: DataFrame, path: str, resume: bool = False) -> None:
    """JSON lines without null fields; a resumed run appends."""
    rows.write.mode("append" if resume else "overwrite").option("ignoreNullFields", True).json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One seed a line; blank lines and those that begin with # don't count."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def seed_packs() -> list[str]:
    """Names of the seed lists that come with the package."""
    return sorted(p.name[:-4] for p in resources.files("weftline.sources").joinpath("packs").iterdir() if p.name.endswith(".txt"))


def seed_pack(name: str) -> list[str]:
    if name not in seed_packs():
        raise ValueError(f"no seed pack {name!r}; there are: {', '.join(seed_packs())}")
    lines = resources.files("weftline.sources").joinpath("packs", f"{name}.txt").read_text().splitlines()
    return [x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#")]


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """The hashes of earlier runs; none where the table isn't there yet."""
    try:
        return spark.read.schema("hash string").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "hash string")


def append_hashes(spark: SparkSession, hashes: DataFrame, path: str) -> None:
    """Adds those of the hashes that aren't there."""
    new = hashes.select("hash").distinct().join(read_hashes(spark, path), "hash", "left_anti")
    new.write.mode("append").parquet(path)


STATE = ("seen_urls", "seen_content", "to_visit", "visited_for_links")


def save_state(path: str, tables: dict[str, DataFrame], saved: int, seeds: list[str], round_: int | None = None) -> None:
    """Adds what a round has added to the sets of a crawl, and then says so in a note: without
    it, after a crash, the round counts as not done. Rows are never written twice; to_visit
    has all that was ever queued, and what of it is still to visit is what isn't seen.
    Without a round the tables are the whole state, in place of any before."""
    spark = next(iter(tables.values())).sparkSession
    fs, jpath = _files(spark, path)
    if round_ is None:
        fs.delete(jpath(path), True)
        round_ = 0
    for name in STATE:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}/round={round_}")
    note = json.dumps({"round": round_, "saved_count": saved, "seeds": seeds})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current-{round_}")
    if round_:
        fs.delete(jpath(f"{path}/current-{round_ - 1}"), True)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def load_state(spark: SparkSession, path: str) -> dict | None:
    """The tables with round, saved_count and seeds, or None where no state was saved."""
    fs, jpath = _files(spark, path)
    if not fs.exists(jpath(path)):
        return None
    names = [status.getPath().getName() for status in fs.listStatus(jpath(path))]
    rounds = [int(n.removeprefix("current-")) for n in names if n.startswith("current-") and fs.exists(jpath(f"{path}/{n}/_SUCCESS"))]
    if not rounds:
        return None
    note = json.loads(spark.read.text(f"{path}/current-{max(rounds)}").first()[0])
    return {n: state_table(spark, path, n, note["round"]) for n in STATE} | {"round": note["round"], "saved_count": note["saved_count"], "seeds": note["seeds"]}


def state_table(spark: SparkSession, path: str, name: str, upto: int) -> DataFrame:
    """A set of the state as of a round."""
    own = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return own.where(F.col("round") <= upto).drop("round")


def drop_state(spark: SparkSession, path: str) -> None:
    fs, jpath = _files(spark, path)
    fs.delete(jpath(path), True)


def write_files(rows: DataFrame, folder: str, body: str = "rendered", name: str = "path") -> None:
    """A file for each row in a folder that all executors share. A repeated task writes the
    same bytes again and renames them into place."""

    def put(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for file, text in zip(b[name], b[body]):
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(text.encode())
                os.replace(part, os.path.join(folder, os.path.basename(file)))
            yield b[[name]]

    small_batches(rows.sparkSession)
    rows.select(name, body).mapInPandas(put, f"{name} string").write.format("noop").mode("overwrite").save()


def append_log(spark: SparkSession, entries: list[dict], path: str) -> None:
    """Appends entries to a log of JSON lines."""
    spark.createDataFrame([(json.dumps(e, sort_keys=True),) for e in entries], "value string").write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(fixture, html, query, answer_span): pages joined with the query file beside them, by
    the name before the suffix; pages without queries are left out."""
    stem = F.regexp_extract(F.col("path"), r"([^/]*?)(?:[.](?:html|queries[.]json))$", 1)
    files = lambda glob: spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    html = files("*.html").select(stem.alias("fixture"), F.col("value").alias("html"))
    asked = files("*.queries.json").select(stem.alias("fixture"), F.explode(F.from_json("value", "array<struct<query string, answer_span string>>")).alias("q"))
    return html.join(asked, "fixture").select("fixture", "html", "q.query", "q.answer_span")


def decoded(body: Column, declared: Column) -> Column:
    """Text of a response: bytes declared Latin-1 that are valid UTF-8 are read as UTF-8."""
    latin = F.coalesce(F.lower(declared).isin("iso-8859-1", "latin-1"), F.lit(False))
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).when(latin, F.decode(body, "ISO-8859-1")).otherwise(F.make_valid_utf8(body.cast("string")))


def write_current(spark: SparkSession, df: DataFrame, path: str) -> None:
    """A small table as a new version; readers of the version before aren't disturbed."""
    fs, jpath = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(jpath(path))] if fs.exists(jpath(path)) else []
    n = 1 + max((int(x) for x in names if x.isdigit()), default=0)
    df.coalesce(1).write.parquet(f"{path}/{n}")


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest whole version of write_current, or None."""
    fs, jpath = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(jpath(path))] if fs.exists(jpath(path)) else []
    whole = [int(x) for x in names if x.isdigit() and fs.exists(jpath(f"{path}/{x}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(whole)}") if whole else None
