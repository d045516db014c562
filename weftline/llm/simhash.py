"""SimHash near-duplicate groups by May-Ozerov nearest-neighbour recursion.

A document's fingerprint has 256 bits: each distinct word (lower case, punctuation
apart) votes for the bits of its hash, weighted by its length up to 12 bytes, so that
rare long words outweigh the function words that all texts share.

The search for pairs within `radius` bits draws random strips of 15 coordinates. On a
strip a fingerprint goes to the list of the centre from which its partial weight (the
weight of strip XOR centre) is at most 1. The centres are the 2048 words of a Hamming
code, whose balls of radius 1 fill the strip exactly: every fingerprint is in one list
a strip, none is lost and none is stored twice. Lists beyond `small` fingerprints are
filtered again on further strips, down to lists that are compared in full. Everything is
repeated over `repeats` independent strips. Two fingerprints whose bits differ with
probability g share a list with probability P0 + P1/8 + P2/8, where Pi is the binomial
chance of i differing bits in 15; `repeats_for` turns that into the number of repetitions
for a target recall, at every depth of recursion. Families of near copies, which no strip
parts, are taken out of long lists first, with all their links. The lists of the first
strip are spread over the cluster; the recursion below them runs where the list is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.plumbing import by_key, connected_components, kept, numbers, shards, small_batches
from weftline.llm.textarrays import U64, mix, pieces, word_hashes, words

BITS, STRIP, LONGEST = 256, 15, 12
DEEPEST = 24  # levels of strips; a list that is still long there is searched in full, star by star
SHORT = 256  # lists below a strip that are compared together, pair by pair; longer ones one by one
PLANES = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], U64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
for _c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]:
    FOLD[_c] = 32


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the accented Latin-1 letters; ASCII punctuation becomes space."""
    out = FOLD[data]
    if len(data) > 1:
        high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[high] += 32
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((rows, 4) fingerprints, number of distinct words a row)."""
    n = len(offsets) - 1
    data = folded(data)
    starts, ends, rows = words(data, offsets)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(n), np.diff(rows))
    _, first = np.unique(h + mix(row.astype(U64) + U64(1)), return_index=True)
    first.sort()
    h, row, weight = h[first], row[first], np.minimum(ends - starts, LONGEST)[first].astype(np.float32)
    at = np.searchsorted(row, np.arange(n + 1))
    out = np.zeros((n, BITS), bool)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        a, b = at[lo], at[hi]
        for plane in range(4):
            planes = mix(h[a:b] + PLANES[plane])
            bits = np.unpackbits(planes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for i in range(lo, hi):
                s, e = at[i] - a, at[i + 1] - a
                if e > s:
                    w = weight[a + s : a + e]
                    out[i, plane * 64 : plane * 64 + 64] = w @ bits[s:e] > w.sum() / 2
    return np.packbits(out, axis=1).view(U64).reshape(n, 4), np.diff(at)


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in pieces(batches, "text", 1 << 18):
        fp, n = fingerprints(data, offsets)
        some = n > 0
        fp = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), *(pa.array(fp[some, i]) for i in range(4))], ["doc_id", "f0", "f1", "f2", "f3"])


# --- May-Ozerov lists


def strip(seed: int) -> tuple[np.ndarray, int]:
    """15 random coordinates and a random shift of the centres on them."""
    rng = np.random.default_rng([20150426, seed])
    return rng.choice(BITS, STRIP, replace=False), int(rng.integers(1 << STRIP))


def _nearest() -> np.ndarray:
    """The centre of each of the values that a strip can have."""
    x = np.arange(1 << STRIP)
    syndrome = np.zeros(len(x), np.int64)
    for i in range(STRIP):
        syndrome ^= ((x >> i) & 1) * (i + 1)
    return np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x).astype(np.uint16)


NEAREST = _nearest()


@functools.lru_cache(64)
def strips(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The strips of n seeds from that one on: (256, n) weights that make a strip's value of
    bits, exact in single precision, and the shifts."""
    weights, shifts = np.zeros((BITS, n), np.float32), np.zeros(n, np.uint16)
    for k in range(n):
        coords, shifts[k] = strip(seed + k)
        weights[coords, k] = 1 << np.arange(STRIP)
    return weights, shifts


def strips_centres(fp: np.ndarray, seed: int, n: int) -> np.ndarray:
    """(n, rows): strip_centres of n seeds from that one on."""
    weights, shifts = strips(seed, n)
    out = np.empty((n, len(fp)), np.uint16)
    for lo in range(0, len(fp), 2048):
        part = np.ascontiguousarray(fp[lo : lo + 2048], "<u8").view(np.uint8)
        values = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32) @ weights
        out[:, lo : lo + 2048] = NEAREST[values.astype(np.uint16) ^ shifts].T
    return out


def strip_centres(fp: np.ndarray, seed: int) -> np.ndarray:
    """For each fingerprint the one centre within partial weight 1 of it on the strip."""
    return strips_centres(fp, seed, 1)[0]


def same_list(gap: float) -> float:
    """Chance that two fingerprints share a list of one strip if their bits differ with probability gap."""
    p = [comb(STRIP, i) * gap**i * (1 - gap) ** (STRIP - i) for i in range(3)]
    return p[0] + p[1] / 8 + p[2] / 8


def repeats_for(gap: float, recall: float) -> int:
    """Strips a level, so that a pair at that gap is found with probability `recall` at least,
    however deep its lists are filtered again: a pair found below with probability s is
    found by R strips with 1 - (1 - s * same_list)**R, and with this R s = recall gives
    recall again."""
    return ceil(log(1 - recall) / log(1 - recall * same_list(gap)))


def list_rows(repeats: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fp = numbers(batch.column(0)), np.stack([numbers(batch.column(i)) for i in range(1, 5)], axis=1)
            for r, centres in enumerate(strips_centres(fp.view(U64), 0, repeats)):
                yield pa.RecordBatch.from_arrays([pa.array((r << STRIP) + centres.astype(np.int32)), pa.array(ids), *(pa.array(fp[:, i]) for i in range(4))], ["list", "doc_id", "f0", "f1", "f2", "f3"])

    return rows


def distances(fp: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits of two arrays of fingerprints, broadcast against each other."""
    return sum(np.bitwise_count(fp[..., i] ^ other[..., i]).astype(np.uint16) for i in range(4))


class ListSearch:
    """The components of one list. Node numbers are in order of id; parent leads each node to
    the least node known to hang together with it. Memory is linear in the list: pairs
    are joined block by block and not kept."""

    def __init__(self, fp: np.ndarray, radius: int, small: int, inner: int):
        self.fp, self.radius, self.small, self.inner = fp, radius, small, inner
        self.parent = np.arange(len(fp))

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def compare(self, nodes: np.ndarray) -> None:
        """All pairs of a small list, unless it is one component already. Half of the bits
        settle most pairs; only the rest are looked at in full."""
        if (self.parent[nodes] == self.parent[nodes[0]]).all():
            return
        fp = self.fp[nodes]
        f0, f1 = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])
        step = max(1, (1 << 16) // len(nodes))
        for lo in range(0, len(nodes), step):
            hi = lo + step
            half = np.bitwise_count(f0[lo:hi, None] ^ f0[lo:]) + np.bitwise_count(f1[lo:hi, None] ^ f1[lo:])
            x, y = np.divmod(np.flatnonzero(half <= self.radius), len(nodes) - lo)
            ahead = y > x
            x, y = x[ahead] + lo, y[ahead] + lo
            close = distances(fp[x], fp[y]) <= self.radius
            self.unite(nodes[x[close]], nodes[y[close]])

    def compare_short(self, order: np.ndarray, after: np.ndarray) -> None:
        """All pairs of many short lists, which stand one behind the other in order; after
        tells how many nodes of its list each has behind it. Half of the bits settle most
        pairs; those that hang together already need no further look."""
        f0, f1 = self.fp[order, 0], self.fp[order, 1]
        at, k = np.flatnonzero(after), 1
        while len(at):
            for lo in range(0, len(at), 1 << 15):
                i = at[lo : lo + (1 << 15)]
                half = np.bitwise_count(f0[i] ^ f0[i + k]) + np.bitwise_count(f1[i] ^ f1[i + k])
                i = i[half <= self.radius]
                a, b = order[i], order[i + k]
                apart = self.parent[a] != self.parent[b]
                a, b = a[apart], b[apart]
                close = distances(self.fp[a], self.fp[b]) <= self.radius
                self.unite(a[close], b[close])
            at = at[after[at] > k]
            k += 1

    def absorb(self, nodes: np.ndarray, pivot: int, gap: np.ndarray) -> np.ndarray:
        """Joins the pivot's star (what lies within the radius of it) and all links of the star
        to the rest, which is returned. By the triangle inequality a node at distance d of
        the pivot can only be near nodes up to radius + d away from it; a node of the rest
        needs no further look once it is joined."""
        star = gap <= self.radius
        members, own, rest = nodes[star], gap[star], nodes[~star]
        self.unite(members, np.full(len(members), pivot))
        order = np.argsort(gap[~star], kind="stable")
        ring, ring_gap = rest[order], gap[~star][order]
        far = np.argsort(-own.astype(np.int64), kind="stable")
        members, own = members[far], own[far]
        at = 0
        while at < len(members):
            reach = int(np.searchsorted(ring_gap, own[at] + self.radius, "right"))
            if not reach:
                break
            step = max(1, (1 << 18) // reach)
            near = (distances(self.fp[members[at : at + step], None], self.fp[None, ring[:reach]]) <= self.radius).any(axis=0)
            if near.any():
                self.unite(ring[:reach][near], np.full(int(near.sum()), pivot))
                keep = np.ones(len(ring), bool)
                keep[:reach] = ~near
                ring, ring_gap = ring[keep], ring_gap[keep]
            at += step
        return rest

    def search(self, nodes: np.ndarray, seed: int, level: int = 0) -> None:
        rng = np.random.default_rng([20150426, seed, 1])
        misses = 0
        # Families of near copies, which strips don't part, go first: they are an eighth of
        # the list or more, so a random node finds one soon.
        while len(nodes) > self.small and misses < 8:
            pivot = int(nodes[rng.integers(len(nodes))])
            gap = distances(self.fp[nodes], self.fp[pivot])
            if level < DEEPEST and 8 * int((gap <= self.radius).sum()) < len(nodes):
                misses += 1
            else:
                nodes = self.absorb(nodes, pivot, gap)
        if len(nodes) <= self.small:
            if len(nodes) > 1:
                self.compare(nodes)
            return
        # Most lists of a strip are of a few nodes, so the lists of several strips are cut
        # and compared at once.
        n, step = len(nodes), max(1, (1 << 19) // len(nodes))
        for lo in range(0, self.inner, step):
            first = seed * 128 + lo + 1
            keys = strips_centres(self.fp[nodes], first, min(step, self.inner - lo))
            order = np.argsort(keys, axis=1, kind="stable")
            keys = np.take_along_axis(keys, order, axis=1)
            order = nodes[order.ravel()]
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=len(order))
            long_ = sizes > min(SHORT, self.small)
            after = np.repeat(np.where(long_, 0, starts + sizes - 1), sizes) - np.arange(len(order))
            self.compare_short(order, np.maximum(after, 0))
            for i in np.flatnonzero(long_).tolist():
                self.search(order[starts[i] : starts[i] + sizes[i]], first + int(starts[i]) // n, level + 1)


def close_in_list(ids: np.ndarray, fp: np.ndarray, radius: int, small: int, inner: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the fingerprints of one list that are joined to another."""
    order = np.argsort(ids, kind="stable")
    found = ListSearch(fp[order], radius, small, inner)
    found.search(np.arange(len(ids)), seed)
    moved = np.flatnonzero(found.parent != np.arange(len(ids)))
    return ids[order[moved]], ids[order[found.parent[moved]]]


def close_pairs(radius: int, small: int, inner: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "list"):
            cols = [numbers(table.column(i).combine_chunks()) for i in range(6)]
            keys, ids, fp = cols[0], cols[1], np.stack(cols[2:], axis=1).view(U64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            found = []
            for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
                s, e = cuts[i], cuts[i + 1]
                found.append(close_in_list(ids[s:e], fp[s:e], radius, small, inner, (int(keys[s]) >> STRIP) + 1))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    return rows


def near_groups(spark: SparkSession, docs: DataFrame, radius: int = 52, recall: float = 0.92, small: int = 1024) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the
    least doc_id of its group. Documents are near duplicates if their fingerprints differ
    in at most `radius` of 256 bits; groups are the connected components of that relation.
    Of pairs at exactly `radius` bits at least `recall` are found, of nearer ones more.

    Any table with doc_id and text will do; other columns are not read. Documents whose
    text is null or has no word take no part, nor do rows with a null doc_id. Rows that
    repeat a doc_id act as one document. A very long text has one fingerprint of all its
    words. Equal fingerprints are searched for once and join their group by a join. An
    empty table gives no rows.
    """
    small_batches(spark)
    repeats = repeats_for(radius / BITS, recall)
    prints = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fingerprint_rows, "doc_id long, f0 long, f1 long, f2 long, f3 long")
    prints = kept(spark, prints, "fingerprints")
    f = ["f0", "f1", "f2", "f3"]
    firsts = kept(spark, prints.groupBy(*f).agg(F.min("doc_id").alias("doc_id")).select("doc_id", *f), "first-fingerprints")
    same = prints.join(firsts.withColumnRenamed("doc_id", "b"), f).select(F.col("doc_id").alias("a"), "b").where("a <> b")
    lists = firsts.mapInArrow(list_rows(repeats), "list int, doc_id long, f0 long, f1 long, f2 long, f3 long")
    parts = shards(spark, firsts.count() * repeats, 1 << 19)
    pairs = lists.repartition(parts, "list").sortWithinPartitions("list").mapInArrow(close_pairs(radius, small, repeats), "a long, b long")
    return connected_components(spark, pairs.unionByName(same), "near").select(F.col("node").alias("doc_id"), F.col("component").alias("group_id")).distinct()


def one_of_each_group(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents without those that are near duplicates of one with a lesser doc_id in
    their group. All columns pass through, whatever they are called; documents without a
    doc_id, text or word are kept, and rows that share a doc_id share its fate."""
    drop = kept(spark, near_groups(spark, docs, **options).where("doc_id <> group_id").select("doc_id"), "near-drop")
    return docs.join(drop, docs["doc_id"] == drop["doc_id"], "left_anti")
