"""Bringing together the places where a run of `least` words may occur twice.

Every window of `least` words has an anchor: the leftmost of its 16-word shingles with the
least hash. Equal windows have equal anchors, so a window whose anchor occurs nowhere else
can't be repeated. The union of the windows of a run with one anchor is a body. Equal bodies
are repeated from end to end, so copies, however many, are settled by two sums over hashes
and one body stands for all. Where an anchor has differing bodies, one of each kind goes to
the partition of its hash, where an index over all texts of that partition (an RLZ
reference block, or a run-length BWT) finds the matches, exactly and over every document.
An anchor with too many differing bodies for a task has its windows compared one by one
instead. The anchors of unrepeated text, which is most text, are all that is shuffled of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.plumbing import by_key, dropped, kept, numbers, shards, small_batches
from weftline.llm.textarrays import POWERS, U64, first_equals, mix, pieces, prefix_sums, ranges, span_hash, text_buffers, window_argmin, word_hashes, words

SHINGLE = 16
GROUP_ROWS = 8192
COMPARED = 1 << 20
HOT = 50_000  # differing bodies of an anchor; beyond, its windows are compared one by one


def anchor_runs(hashes: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, first window, last window, places) of the runs of windows with equal
    anchor hashes; windows are numbered by their first word in the row, and places is 2 if
    the anchor moves within the run, as in periodic text, else 1."""
    empty = np.zeros(0, np.int64)
    counts = np.diff(rows)
    if not len(counts) or counts.max() < least:
        return (empty,) * 5
    shingles = span_hash(prefix_sums(hashes), np.arange(max(0, len(hashes) - SHINGLE + 1)), np.arange(SHINGLE, len(hashes) + 1))
    best = window_argmin(shingles, least - SHINGLE + 1)  # best[t]: the anchor of window t, t + least <= all words
    per = np.maximum(0, counts - least + 1)
    row = np.repeat(np.arange(len(counts)), per)
    at = ranges(rows[:-1], per)
    place = best[at]
    value = shingles[place]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    local = at - rows[:-1][row]
    return row[first], value[first].view(np.int64), local[first], local[last], 1 + (place[first] != place[last])


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each range of word hashes, each word mixed with its place in the range."""
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(owner)) - first[owner]
    return np.add.reduceat(mix(hashes[starts[owner] + nth] + mix(nth.astype(U64) + U64(1))), first) if len(owner) else np.zeros(0, U64)


def places_of(doc: np.ndarray, row: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One number for a word of a text."""
    return mix(mix(doc.view(U64) + U64(1)) ^ mix(row.view(U64)) + s.astype(U64)).view(np.int64)


def anchors(least: int):
    """(h, b, place, doc_id, row, s, e, places) of the runs of windows of each text; b is a hash
    of the run's words, from the first word of its first window to the last of its last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            starts, ends, at = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            row, h, s, e, m = anchor_runs(hashes, at, least)
            if len(row):
                doc, digest = numbers(batch.column(0))[row], numbers(batch.column(2))[row]
                body = sequence_hashes(hashes, at[row] + s, e - s + least).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(body), pa.array(places_of(doc, digest, s)), pa.array(doc), pa.array(digest), *(pa.array(x.astype(np.int32)) for x in (s, e, m))], ["h", "b", "place", "doc_id", "row", "s", "e", "places"])

    return rows


def run_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row of the batch, h, s, e) of the runs listed in its last column."""
    runs = batch.column(3)
    flat = runs.flatten()
    h, s, e = (numbers(flat.field(k)) for k in range(3))
    return np.repeat(np.arange(batch.num_rows), np.diff(numbers(runs.offsets))), h, s.astype(np.int64), e.astype(np.int64)


def surroundings(least: int):
    """The texts of the listed runs of each document: (h, doc_id, row, s, body); body is the
    words from s on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            starts, ends, at = words(data, offsets)
            row, h, s, e = run_columns(batch)
            lo, hi = starts[at[row] + s], ends[at[row] + e + least - 1]
            cells = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32).tobytes()), pa.py_buffer(data[ranges(lo, hi - lo)].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(numbers(batch.column(0))[row]), pa.array(numbers(batch.column(2))[row]), pa.array(s.astype(np.int32)), cells], ["h", "doc_id", "row", "s", "body"])

    return rows


def single_windows(least: int):
    """(h, b, place, doc_id, row, s) of every window of the listed runs; b hashes its words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text", 1 << 18):
            starts, ends, at = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            row, h, s, e = run_columns(batch)
            n = e - s + 1
            row, h, s = np.repeat(row, n), np.repeat(h, n), ranges(s, n)
            for lo in range(0, len(h), 1 << 13):
                r, w = row[lo : lo + (1 << 13)], s[lo : lo + (1 << 13)]
                doc, digest = numbers(batch.column(0))[r], numbers(batch.column(2))[r]
                body = sequence_hashes(hashes, at[r] + w, np.full(len(r), least)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 13)]), pa.array(body), pa.array(places_of(doc, digest, w)), pa.array(doc), pa.array(digest), pa.array(w.astype(np.int32))], ["h", "b", "place", "doc_id", "row", "s"])

    return rows


class Block:
    """The texts of some groups as one sequence of word numbers. Surroundings of one document
    that overlap are joined, so that no word of the corpus is in it twice; each text ends
    with a number of its own, which matches nothing."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, s: np.ndarray, bodies: pa.Array):
        data, offsets = text_buffers(bodies)
        starts, ends, at = words(data, offsets)
        n = np.diff(at)
        order = np.lexsort((s, row, doc))
        d, r, b, e = doc[order], row[order], s[order], s[order] + n[order]
        head = np.ones(len(order), bool)
        head[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
        group = np.cumsum(head) - 1
        big = np.int64(1 << 40)
        reach = np.maximum.accumulate(e + group * big) - group * big  # furthest end so far in the document
        before = np.where(head, -1, np.append(-1, reach[:-1]))
        fresh = head | (b > before)
        skip = np.where(fresh, 0, np.minimum(before - b, n[order]))
        own = n[order] - skip
        src = ranges(at[:-1][order] + skip, own)
        text = np.cumsum(fresh) - 1
        sizes = np.bincount(text, weights=own).astype(np.int64) if len(text) else np.zeros(0, np.int64)
        self.doc, self.row, self.first = d[fresh], r[fresh], b[fresh]
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # of texts in the sequence
        values, _, ids = first_equals(data, starts[src], ends[src])
        self.tokens = np.empty(self.starts[-1], np.int64)
        gaps = self.starts[1:] - 1
        inside = np.ones(len(self.tokens), bool)
        inside[gaps] = False
        self.tokens[inside] = ids
        self.tokens[gaps] = len(values) + np.arange(len(gaps))
        self.ends = np.repeat(gaps, sizes + 1)  # of the text around each place

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, its inverse) by prefix doubling; only suffixes still tied are sorted on."""
        n = len(self.tokens)
        order = np.argsort(self.tokens, kind="stable")
        key = self.tokens[order]
        rank = np.empty(n, np.int64)
        tied, group_key, k = order, key, 1
        base_of = np.arange(n)  # slot of each entry of `tied` in the suffix array
        sa = np.empty(n, np.int64)
        while len(tied):
            new = np.ones(len(tied), bool)
            new[1:] = group_key[1:] != group_key[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
            rank[tied] = base_of[first]
            sa[base_of] = tied
            single = new & np.append(new[1:], True)
            tied, base_of = tied[~single], base_of[~single]
            if not len(tied):
                break
            nxt = rank[np.minimum(tied + k, n - 1)]
            group_key = rank[tied] * (n + 1) + nxt
            by = np.argsort(group_key, kind="stable")
            tied, group_key = tied[by], group_key[by]
            k *= 2
        return sa, rank

    def sums(self) -> np.ndarray:
        return prefix_sums(mix(self.tokens.astype(U64) + U64(1)))

    def common(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b, but `most` at
        most: found by hashes, which can only say too much, and then compared word by word.
        The caller sees to it that the sum of the lengths is small."""
        _, down = POWERS.upto(len(sums))
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.ends[a] - a, self.ends[b] - b)
        if most is not None:
            hi = np.minimum(hi, most)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi + 1) >> 1
            same = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
            lo, hi = np.where(same, mid, lo), np.where(same | ~open_, hi, mid - 1)
        some = np.flatnonzero(lo)
        upto = np.cumsum(lo[some])
        for i in range(0, int(upto[-1]) if len(some) else 0, COMPARED):  # a stretch of words at a time
            part = some[np.searchsorted(upto, i, "right") : np.searchsorted(upto, i + COMPARED, "right")]
            if len(part):
                n = lo[part]
                differ = self.tokens[ranges(a[part], n)] != self.tokens[ranges(b[part], n)]
                if differ.any():
                    first = np.cumsum(n) - n
                    nth = np.arange(len(differ)) - np.repeat(first, n)
                    lo[part] = np.minimum.reduceat(np.where(differ, nth, np.repeat(n, n)), first)
        return lo

    def spans(self, at: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """doc, row, first word and end of the union of the ranges [at, at + length)."""
        depth = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + length, -1)
        cover = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(self.starts, lo, "right") - 1
        off = self.first[text] - self.starts[text]
        return [self.doc[text], self.row[text], lo + off, hi + off]


Engine = Callable[[Block, int], tuple[np.ndarray, np.ndarray]]


def matched(engine: Engine, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "h", GROUP_ROWS):
            doc, row, s = (numbers(table.column(i).combine_chunks()).astype(np.int64) for i in (1, 2, 3))
            body = table.column(4).combine_chunks()
            block = Block(doc, row, s, body)
            out = block.spans(*engine(block, least))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc_id", "row", "s", "e"])

    return rows


def repeated_spans(spark: SparkSession, docs: DataFrame, engine: Engine, least: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal ranges of words of each document
    that are covered by runs of `least` words or more that occur at another place, in the
    same or another document. Words are counted from 0, the end is exclusive.

    Words are the runs between ASCII white space. Bodies are equal if two 64-bit hashes are,
    of the anchor and of all words with their places; within a block words are compared
    byte for byte. Rows with a null doc_id or text, and texts of fewer than `least` words, have no spans. Identical rows
    count once; differing texts under one doc_id are texts of their own whose spans all
    carry that doc_id. A very long text is one text, never cut. Other columns are not read;
    an empty table gives no rows.
    """
    if least < SHINGLE + 1:
        raise ValueError(f"least must be over {SHINGLE} words")
    small_batches(spark)
    text = F.col("text").cast("string")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    found = kept(spark, texts.mapInArrow(anchors(least), "h long, b long, place long, doc_id long, row long, s int, e int, places int"), "anchors")
    # An anchor at one place only is of no further use. Both sums combine on the map side; the
    # joins back are by keys that adaptive execution splits where they are skewed.
    per = found.groupBy("h").agg(F.min("place").alias("p0"), F.max("place").alias("p1"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.max("places").alias("m")).where("p0 <> p1 or m > 1")
    again = kept(spark, found.join(per.select("h", F.expr("b0 <> b1").alias("mixed")), "h").dropDuplicates(["h", "place"]), "repeated-anchors")
    dropped(spark, found)
    bodies = again.groupBy("h", "b").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    # Equal bodies are repeated from end to end; one of them stands for all where others share the anchor.
    settled = kept(spark, again.join(bodies, ["h", "b"]), "bodies")
    dropped(spark, again)
    whole = settled.where("lo <> hi").select("doc_id", "row", F.col("s").cast("long").alias("s"), (F.col("e") + least).cast("long").alias("e"))
    rest = settled.where("place = lo and (mixed or (lo = hi and places > 1))").select("h", "doc_id", "row", "s", "e")
    crowds = kept(spark, rest.groupBy("h").count().where(F.col("count") > hot).select("h"), "hot-anchors")
    spans = whole
    if not crowds.isEmpty():
        spans = spans.unionByName(by_windows(spark, texts, rest.join(crowds, "h", "left_semi"), least))
        rest = rest.join(crowds, "h", "left_anti")
    around = with_runs(texts, rest).mapInArrow(surroundings(least), "h long, doc_id long, row long, s int, body binary")
    spans = spans.unionByName(around.repartition(shards(spark, rest.count(), 1 << 17), "h").sortWithinPartitions("h").mapInArrow(matched(engine, least), "doc_id long, row long, s long, e long"))
    by_start = Window.partitionBy("doc_id", "row").orderBy("s", "e")
    marked = spans.withColumn("reach", F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))).withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy("doc_id", "row", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, text, row, runs) of the texts that have runs; identical rows are one."""
    own = runs.groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "s", "e")).alias("runs"))
    return texts.join(own, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "text", "row", "runs")


def by_windows(spark: SparkSession, texts: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """The repeated windows of runs whose anchor has so many differing surroundings that no
    task should hold them: each window is a row, and equal ones are found by their hash."""
    windows = kept(spark, with_runs(texts, runs).mapInArrow(single_windows(least), "h long, b long, place long, doc_id long, row long, s int"), "windows")
    twice = windows.groupBy("h", "b").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("h", "b")
    return windows.join(twice, ["h", "b"], "left_semi").select("doc_id", "row", F.col("s").cast("long").alias("s"), (F.col("s") + least).cast("long").alias("e"))


SQL = """
WITH texts AS (
  SELECT DISTINCT doc_id, md5(text) AS row_key, list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda w: w <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT doc_id, row_key, unnest(list_transform(range(0, len(ws) - {least} + 1), lambda i: {{'s': i, 'h': md5(array_to_string(list_slice(ws, i + 1, i + {least}), ' '))}})) AS w
  FROM texts WHERE len(ws) >= {least}
), repeated AS (
  SELECT doc_id, row_key, w.s AS s FROM windows WHERE w.h IN (SELECT w.h FROM windows GROUP BY w.h HAVING count(*) > 1)
), islands AS (
  SELECT doc_id, row_key, s, sum(fresh) OVER (PARTITION BY doc_id, row_key ORDER BY s) AS island FROM (
    SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, row_key ORDER BY s) <= {least} THEN 0 ELSE 1 END AS fresh FROM repeated
  ) AS f
)
SELECT doc_id, min(s) AS start_word, max(s) + {least} AS end_word, max(s) + {least} - min(s) AS n_words
FROM islands GROUP BY doc_id, row_key, island
"""
