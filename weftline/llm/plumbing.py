"""Tables kept between the steps of an operator, and grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.tables import dropped, kept, shared_dir, small_batches

__all__ = ["by_key", "columns_of", "connected_components", "dropped", "kept", "numbers", "shards", "shared_dir", "small_batches"]


def columns_of(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    return (column.fill_null(null) if column.null_count else column).to_numpy(zero_copy_only=False)


def by_key(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Runs of whole groups of a stream that is sorted by an integer key, of about `most`
    rows each; a larger group comes as one run."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        keys = numbers(table.column(key).combine_chunks())
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
        most = max(most, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shards(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows, at least those the session shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def connected_components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the undirected graph with edges (a, b): the component is its
    least node. Alternates large-star and small-star steps, each written to the shared
    folder, until nothing changes; the number of rounds is logarithmic in practice.
    Null ends and loops are ignored; an empty graph gives no rows. Two rounds give the same
    edges if their numbers and the sums of their hashes are equal.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = kept(spark, edges, name), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("e"), "m")
        nxt = kept(spark, small.select(F.col("e.x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        sign = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(spark, edges)
        edges = nxt
        if sign == last or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = sign
