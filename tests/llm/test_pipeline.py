"""The pipeline stage by stage against plain Python, and whole."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_dedup import components
from tests.llm.test_mixing import counted, plainly_mixed
from weftline.llm import bytecnn, simhash
from weftline.llm.textarrays import text_buffers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert 4 <= len(cp.STAGES) <= 5
    before = docs
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        rows, old = out.collect(), before.collect()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            keep = {r["doc_id"] for r in bytecnn.scored(before, bytecnn.fitted(before, labels)).collect() if r["keep"]}
            assert {r["doc_id"] for r in rows} == keep and len(keep) < len(old)
        elif name == "exact dedup":
            first = {}
            for r in old:
                first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in rows) == sorted(first.values())
        elif name == "near dedup":
            # All pairs of fingerprints: of every group the least doc_id stays; a few links may be missed.
            ids = [r["doc_id"] for r in sorted(old, key=lambda r: r["doc_id"])]
            fp, n = simhash.fingerprints(*text_buffers(pa.array([r["text"] for r in sorted(old, key=lambda r: r["doc_id"])])))
            close = [(a, b) for a, b in zip(*np.nonzero(simhash.distances(fp[:, None], fp[None, :]) <= 52)) if a < b and n[a] and n[b]]
            label = components(len(ids), close)
            want, stay = {ids[i] for i in range(len(ids)) if label[i] == i}, {r["doc_id"] for r in rows}
            assert want <= stay and len(stay - want) <= 0.1 * (len(ids) - len(want)) and len(want) < len(ids)
        elif name == "mixing":
            h = {r["doc_id"]: r["h"] for r in before.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).collect()}
            uses = plainly_mixed([(r["doc_id"], r["source"], r["lang"], n, h[r["doc_id"]]) for r, n in counted(before)])
            assert Counter(r["doc_id"] for r in rows) == Counter(u[0] for u in uses)
            assert {repr(r) for r in rows} <= {repr(r) for r in old} and max(u[2] for u in uses) > 0 and len({u[0] for u in uses}) < len(old)
        else:
            assert len(rows) == len(old) and all(r["round_trip"] for r in rows)
        if i < len(cp.STAGES) - 1:
            assert out.columns == names
        before = out
    assert sorted(map(repr, cp.run(spark, SF).collect())) == sorted(map(repr, before.collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_ties_and_clashing_columns(spark):
    """Every stage takes null cells, empty and very long texts, repeated rows and columns of any name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (None, "a text without an id", "en", "src0", 1), (9003, "some words of a text", None, None, 1), (9003, "some words of a text", None, None, 1), (9004, "long word " * 100_000, "en", "src0", 1)]
    extra = ("tokens", "names", "h", "keep", "uses", "row", "c0", "group_id")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", *(f"doc_id AS {x}" for x in extra))
    for i, (_, stage) in enumerate(cp.STAGES):
        names = docs.columns
        docs = cp.kept(spark, stage(spark, docs, SF), "odd")
        assert i == len(cp.STAGES) - 1 or docs.columns == names
    assert docs.where("not round_trip").count() == 0 and docs.where("doc_id = 9001").count() == 0
