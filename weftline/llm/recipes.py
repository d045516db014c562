"""Exact deduplication by content-defined chunk recipes.

Texts are cut where the hash of the last 32 bytes has ten zero bits (about 1 KiB a chunk,
256 bytes at least, 8 KiB at most). A chunk travels once a task, to the partition of its
hash; there its bytes are compared with those of the other chunks of that hash, and all
equal ones get the place of the first as their verified identifier. From then on only
identifiers move: documents are equal if their ordered lists of identifiers are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.plumbing import by_key, columns_of, kept, numbers, small_batches
from weftline.llm.textarrays import BYTE_CODES, POWERS, U64, content_keys, mix, pieces, prefix_sums, text_digests

WINDOW, LEAST, MOST, MASK = 32, 256, 8192, U64(1023 << 54)
HELD_BYTES = 32 << 20


def chunk_cuts(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks in row order, chunks of each row); an empty row has one empty chunk."""
    n, ends = len(data), offsets[1:]
    marks = np.zeros(0, np.int64)
    if n > WINDOW:
        _, down = POWERS.upto(n + 1)
        rolling = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1])
        marks = np.flatnonzero((rolling & MASK) == 0) + WINDOW
    cuts: list[int] = []
    counts = np.ones(len(ends), np.int64)
    rows = np.searchsorted(marks, offsets)
    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), ends.tolist())):
        if end - start <= LEAST:
            cuts.append(end)
            continue
        own, before = marks[rows[i] : rows[i + 1]].tolist(), len(cuts)
        while end - start > LEAST:
            k = bisect_left(own, start + LEAST)
            start = min(own[k] if k < len(own) else end, start + MOST, end)
            cuts.append(start)
        if start != end:
            cuts.append(end)
        counts[i] = len(cuts) - before
    return np.array(cuts, np.int64), counts


CHUNKS = "h long, doc_id long, row long, seq int, body binary, r_doc long, r_row long, r_seq int"


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[bytes, tuple[int, int, int]]] = {}
    room = HELD_BYTES
    for batch, data, offsets in pieces(batches, "text"):
        sums = prefix_sums(BYTE_CODES[data])
        cuts, counts = chunk_cuts(data, offsets, sums)
        starts = np.concatenate([[0], cuts[:-1]])
        row = np.repeat(np.arange(len(counts)), counts)
        seq = np.arange(len(cuts)) - np.repeat(np.cumsum(counts) - counts, counts)
        h = content_keys(data, starts, cuts).view(np.int64)
        whole = text_digests(data, offsets)
        ids = numbers(columns_of(batch, "doc_id")[0])
        flat, places = data.tobytes(), list(zip(ids[row].tolist(), whole[row].tolist(), seq.tolist()))
        bodies: list[bytes | None] = []
        refs: list[tuple[int, int, int] | None] = []
        for key, s, e, place in zip(h.tolist(), starts.tolist(), cuts.tolist(), places):
            body = flat[s:e]
            seen = held.get(key)
            if seen is not None and seen[0] == body:
                bodies.append(None)
                refs.append(seen[1])
                continue
            bodies.append(body)
            refs.append(None)
            if seen is None:
                room -= len(body) + 200
                if room < 0:
                    held.clear()
                    room = HELD_BYTES
                held[key] = body, place
        ref = [pa.array([None if r is None else r[k] for r in refs], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[row]), pa.array(whole[row]), pa.array(seq.astype(np.int32)), pa.array(bodies, pa.binary()), *ref], ["h", "doc_id", "row", "seq", "body", "r_doc", "r_row", "r_seq"])


def verified_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The identifier of each chunk: the least place (doc_id, row, seq) with equal bytes."""
    for table in by_key(batches, "h", 8192):
        h, doc, row, seq = (numbers(table.column(i).combine_chunks()) for i in range(4))
        c_doc, c_row, c_seq = doc.copy(), row.copy(), seq.copy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
        bodies, refs = table.column(4), [table.column(i) for i in range(5, 8)]
        for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
            s, e = int(cuts[i]), int(cuts[i + 1])
            own = bodies.slice(s, e - s).to_pylist()
            places = list(zip(doc[s:e].tolist(), row[s:e].tolist(), seq[s:e].tolist()))
            if any(b is None for b in own):
                sent = {p: b for p, b in zip(places, own) if b is not None}
                own = [sent[tuple(c[s + k].as_py() for c in refs)] if b is None else b for k, b in enumerate(own)]
            first: dict[bytes, tuple[int, int, int]] = {}
            for b, p in zip(own, places):
                if b not in first or p < first[b]:
                    first[b] = p
            for k, b in enumerate(own):
                c_doc[s + k], c_row[s + k], c_seq[s + k] = first[b]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, row, seq, c_doc, c_row, c_seq)], ["doc_id", "row", "seq", "c_doc", "c_row", "c_seq"])


def exact_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, row, keep_id, n_copies) of every document that has copies; row is a digest of
    its text that tells texts of the same doc_id apart. keep_id is the least doc_id with an
    equal text and n_copies, over 1, the number of distinct (doc_id, text) that share it.

    Equal means equal bytes; empty texts equal one another. A very long text is many chunks
    and so one long recipe. Rows with a null text or a null doc_id take no part and have no
    row in the result. Identical rows count once. Other columns of the table are not read.
    An empty table gives no rows. A group of copies, however large, is never gathered: its
    members get keep_id by a join on the recipe, which adaptive execution splits if skewed.
    """
    small_batches(spark)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = source.mapInArrow(chunk_rows, CHUNKS)
    checked = chunks.repartition("h").sortWithinPartitions("h").mapInArrow(verified_rows, "doc_id long, row long, seq int, c_doc long, c_row long, c_seq int")
    lists = kept(spark, checked.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("seq", "c_doc", "c_row", "c_seq"))).alias("recipe")), "recipes")
    groups = lists.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return lists.join(groups, "recipe").select("doc_id", "row", "keep_id", "n_copies")


def duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, n_copies) of the documents whose text also stands under a lesser
    doc_id. See exact_groups for nulls, empty texts and repeated rows."""
    return exact_groups(spark, docs).where("doc_id <> keep_id").select("doc_id", "keep_id", "n_copies")


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without exact copies of a text under a lesser doc_id; all columns pass
    through, whatever they are called. Rows without a doc_id or a text are kept. Where a
    doc_id has several rows, each differing text is judged as a document of its own, and
    of rows that repeat doc_id and text one is kept.
    """
    groups = kept(spark, exact_groups(spark, docs).select("doc_id", "row", "keep_id"), "copies")
    repeated = kept(spark, docs.where("doc_id is not null and text is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    drop = groups.where("doc_id <> keep_id").select("doc_id").distinct()
    if repeated.isEmpty():
        return docs.join(drop, docs["doc_id"] == drop["doc_id"], "left_anti")
    plain = docs.join(repeated, docs["doc_id"] == repeated["doc_id"], "left_anti")
    plain = plain.join(drop, plain["doc_id"] == drop["doc_id"], "left_anti")
    shared = docs.join(repeated, docs["doc_id"] == repeated["doc_id"], "left_semi")
    names = shared.columns
    shared = shared.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    # Texts under a repeated doc_id: the least doc_id of each text, over the whole table, by a join on the text itself.
    same = docs.where("text is not null").select(F.col("doc_id").alias("other"), F.col("text").alias("other_text")).join(shared.select(F.col(text).alias("t")).distinct(), F.col("other_text") == F.col("t"), "left_semi")
    least = same.groupBy("other_text").agg(F.min("other").alias("least"))
    ranked = shared.join(least, shared[text] == least["other_text"], "left").withColumn("n", F.when(F.col(text).isNotNull(), F.row_number().over(Window.partitionBy(doc, text).orderBy(F.to_json(F.struct(*shared.columns))))))
    own = ranked.where(F.col("n").isNull() | ((F.col("n") == 1) & (F.col(doc) <= F.coalesce("least", doc)))).select(*shared.columns).toDF(*names)
    return plain.unionByName(own)
