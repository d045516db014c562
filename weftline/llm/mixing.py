"""Mixing overlapping sources to target weights by min-cost flow.

A use of a document counts once on each of two layers: for one of its sources, and for one
of its kinds (here its language). Every source and every kind has a quota of tokens, and
both layers have the whole budget. Documents with the same set of sources and kinds form a
pattern, and the problem is a small flow network: tokens flow from the quotas of the
sources through the patterns to the quotas of the kinds. A pattern lets its tokens through
once for nothing, a second time for 1, a third for 4 and so on (convex costs, so repetition
is spread and comes last); where sources overlap the flow decides for which of them a
document is used. The maximum flow of least cost says how many tokens of each pattern serve
what. Without kinds the patterns lead to the sink and there is one layer.

Documents are then taken in the order of a seeded hash. A pattern's tape is its documents in
that order, over and over; each pair of source and kind owns a stretch of it as long as its
flow. Where stretches begin and end in that order is found by refining the hash, a few bits
a step, in narrow tables without texts; what is left are hash thresholds for each pattern,
and documents are chosen by them in one pass without a shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.plumbing import kept, small_batches
from weftline.llm.textarrays import pieces

STEP_BITS = 12
MOST_PATTERNS = 20_000  # more raise an error: the flow is found on the driver and its thresholds are broadcast
BOTTOM = -(2**63)


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], epochs: int, kinds: list[list[int]] | None = None, kind_quota: list[int] | None = None) -> tuple[list[dict[int, int]], list[dict[int, int]], int]:
    """(flow into each pattern from each of its sources, flow out of it to each of its kinds,
    total cost) of the cheapest maximum flow; the k-th use of a pattern's tokens costs
    (k - 1)**2 each. Successive shortest paths, each found by a queue-based Bellman-Ford
    search over the residual network."""
    n_p, n_c = len(capacity), len(quota)
    n_k = len(kind_quota or ())
    enter, leave, kind_at = n_c, n_c + n_p, n_c + 2 * n_p
    source, sink = kind_at + n_k, kind_at + n_k + 1
    to, room, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, cap: int, c: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((cap, 0))
        cost.extend((c, -c))

    endless = sum(quota) + 1
    for c, q in enumerate(quota):
        arc(source, c, q, 0)
    for p, cap in enumerate(capacity):
        for c in members[p]:
            arc(c, enter + p, endless, 0)
        for k in range(epochs):
            arc(enter + p, leave + p, cap, k * k)
        for d in kinds[p] if kinds is not None else ():
            arc(leave + p, kind_at + d, endless, 0)
        if kinds is None:
            arc(leave + p, sink, endless, 0)
    for d, q in enumerate(kind_quota or ()):
        arc(kind_at + d, sink, q, 0)
    total = 0
    while True:
        best: list[int | None] = [None] * len(out)
        via = [-1] * len(out)
        best[source] = 0
        queue, queued = deque([source]), [False] * len(out)
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                b = to[e]
                if room[e] > 0 and (best[b] is None or best[a] + cost[e] < best[b]):
                    best[b], via[b] = best[a] + cost[e], e
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        if best[sink] is None:
            break
        push, node = None, sink
        while node != source:
            push = room[via[node]] if push is None else min(push, room[via[node]])
            node = to[via[node] ^ 1]
        node = sink
        while node != source:
            room[via[node]] -= push
            room[via[node] ^ 1] += push
            node = to[via[node] ^ 1]
        total += push * best[sink]
    into: list[dict[int, int]] = [{} for _ in range(n_p)]
    onto: list[dict[int, int]] = [{} for _ in range(n_p)]
    for e in range(0, len(to), 2):
        a, b, n = to[e ^ 1], to[e], room[e ^ 1]
        if n > 0 and a < n_c and enter <= b < leave:
            into[b - enter][a] = n
        elif n > 0 and leave <= a < kind_at and kind_at <= b < kind_at + n_k:
            onto[a - leave][b - kind_at] = n
    return into, onto, total


def flattened_targets(tokens: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights by tokens ** power: large sources give way to small ones, without being levelled."""
    weights = {name: max(n, 0) ** power for name, n in tokens.items()}
    total = sum(weights.values()) or 1
    return {name: w / total for name, w in weights.items()}


def quotas(tokens: dict[str, int], targets: dict[str, float] | None, total: int) -> dict[str, int]:
    """Tokens for each name, `total` in all: shares rounded down, the rest to the largest remainders."""
    weights = flattened_targets(tokens) if targets is None else targets
    share = sum(weights.values()) or 1
    exact = {name: total * w / share for name, w in weights.items()}
    found = {name: int(x) for name, x in exact.items()}
    left = (total if weights and sum(weights.values()) > 0 else 0) - sum(found.values())
    for name in sorted(exact, key=lambda n: (found[n] - exact[n], n))[: max(left, 0)]:
        found[name] += 1
    return found


def stretches(into: dict[int, int], onto: dict[int, int] | None) -> list[tuple[int, int, int, int]]:
    """(begin, end, source, kind) on a pattern's tape: sources side by side in their order, kinds likewise."""
    found, at = [], 0
    left = sorted(into.items())
    right = [(-1, sum(into.values()))] if onto is None else sorted(onto.items())
    i = j = 0
    a = left[0][1] if left else 0
    b = right[0][1] if right else 0
    while i < len(left) and j < len(right):
        n = min(a, b)
        if n:
            found.append((at, at + n, left[i][0], right[j][0]))
        at, a, b = at + n, a - n, b - n
        if not a:
            i += 1
            a = left[i][1] if i < len(left) else 0
        if not b:
            j += 1
            b = right[j][1] if j < len(right) else 0
    return found


def token_counts(path: str = bpe.VOCABULARY):
    """A column function: the number of BPE tokens of a text, 0 for a null one."""

    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = bpe.encoder(bpe.on_worker(path))
        for column in texts:
            out: list[int] = []
            for _, data, offsets in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                _, at = enc.encode(data, offsets)
                out += (at[1:] - at[:-1]).tolist()
            yield pa.array(out, pa.int64())

    return count


def source_names() -> Column:
    """The sources of a document of the documents table; a null source is the source ''."""
    return F.array(F.concat(F.lit("source:"), F.coalesce(F.col("source").cast("string"), F.lit(""))))


def kind_names() -> Column:
    """The kinds of a document of the documents table, its language; a null one is ''."""
    return F.array(F.concat(F.lit("lang:"), F.coalesce(F.col("lang").cast("string"), F.lit(""))))


def named(sources: Column, kinds: Column | None, seed: int) -> tuple[Column, Column, Column]:
    """(names of sources and kinds, hash, whether it may be chosen) as columns of docs."""
    in_order = lambda c: F.array_sort(F.array_distinct(F.array_compact(c)))
    pattern = F.struct(in_order(sources).alias("sources"), (in_order(kinds) if kinds is not None else F.array().cast("array<string>")).alias("kinds"))
    usable = (F.length(F.col("text").cast("string")) > 0) & (F.size(pattern["sources"]) > 0)
    return pattern, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")), usable if kinds is None else usable & (F.size(pattern["kinds"]) > 0)


def thresholds(spark: SparkSession, narrow: DataFrame, cuts: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """For each cut (pattern, place within its tokens) the hash at which it falls: documents
    that begin before the cut have lesser hashes. The hashes of a pattern are summed by
    ranges, of STEP_BITS bits a step; only the range in which a cut falls is split on, until
    it holds a single hash. A step sends a row for each open cut to the driver."""
    found: dict[tuple[int, int], int] = {}
    wanted = [(p, x, BOTTOM, x) for p, x in cuts]  # pattern, place, first hash of the range, what is left within it
    width = 64
    while wanted:
        step = min(STEP_BITS, width)
        table = spark.createDataFrame(wanted, "pattern int, place long, base long, rest long")
        rows = narrow.withColumn("base", F.lit(BOTTOM) if width == 64 else F.shiftleft(F.shiftright("h", width), width))
        rows = rows.join(F.broadcast(table.select("pattern", "base").distinct()), ["pattern", "base"])
        parts = rows.groupBy("pattern", "base", F.shiftright("h", width - step).alias("part")).agg(F.sum("tokens").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        # A range has at most 2**STEP_BITS parts, whatever the number of documents.
        upto = Window.partitionBy("pattern", "base").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        hits = parts.join(F.broadcast(table), ["pattern", "base"]).where("before <= rest and rest < before + n").select("pattern", "place", "rest", "part", "before", "low", "high").collect()
        width -= step
        wanted = []
        for r in hits:
            key, left = (r["pattern"], r["place"]), r["rest"] - r["before"]
            if not left:
                found[key] = r["low"]
            elif r["low"] == r["high"]:  # within a document, which begins before the cut
                found[key] = r["high"] + 1
            else:
                wanted.append((*key, r["part"] << width, left))
    return found


def planned(spark: SparkSession, docs: DataFrame, targets: dict[str, float] | None, kind_targets: dict[str, float] | None, budget: float, epochs: int, seed: int, sources: Column, kinds: Column | None, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, pattern, h, tokens of every document that may be chosen; pattern and its uses)."""
    small_batches(spark)
    pattern, h, usable = named(sources, kinds, seed)
    narrow = docs.where(usable).select(F.col("doc_id").alias("doc_id"), pattern.alias("names"), h.alias("h"), token_counts(path)(F.col("text").cast("string")).alias("tokens"))
    narrow = kept(spark, narrow, "mixing")
    seen = narrow.groupBy("names").agg(F.sum("tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(seen) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources and kinds")
    seen = sorted(((tuple(r["names"]["sources"]), tuple(r["names"]["kinds"]), r["n"]) for r in seen))
    per: tuple[dict[str, int], dict[str, int]] = {}, {}
    for own, kind, n in seen:
        for layer, names in zip(per, (own, kind)):
            for x in names:
                layer[x] = layer.get(x, 0) + n
    total = int(sum(n for *_, n in seen) * budget)
    quota, kind_quota = quotas(per[0], targets, total), quotas(per[1], kind_targets, total)
    first, second = sorted(quota), sorted(kind_quota)
    into, onto, _ = min_cost_flow([n for *_, n in seen], [[first.index(x) for x in own if x in quota] for own, _, _ in seen], [quota[x] for x in first], epochs, None if kinds is None else [[second.index(x) for x in kind if x in kind_quota] for _, kind, _ in seen], None if kinds is None else [kind_quota[x] for x in second])
    uses, cuts = [], set()
    for p, (own, kind, n) in enumerate(seen):
        for lo, hi, c, d in stretches(into[p], None if kinds is None else onto[p]):
            for k in range(epochs):
                a, b = max(lo - k * n, 0), min(hi - k * n, n)
                if a < b:
                    uses.append((p, a, b, first[c], second[d] if d >= 0 else None, k))
                    cuts |= {(p, x) for x in (a, b) if 0 < x < n}
    ids = spark.createDataFrame([(p, (list(own), list(kind))) for p, (own, kind, _) in enumerate(seen)], "pattern int, names struct<sources:array<string>,kinds:array<string>>")
    at = thresholds(spark, narrow.join(F.broadcast(ids), "names").select("pattern", "h", "tokens"), sorted(cuts))
    rows: list[list[tuple]] = [[] for _ in seen]
    for p, a, b, c, d, k in uses:
        lo, hi = at.get((p, a), BOTTOM), at.get((p, b), -BOTTOM)
        if lo < hi:
            rows[p].append((lo, hi - 1, c, d, k))
    table = spark.createDataFrame([((list(own), list(kind)), r) for (own, kind, _), r in zip(seen, rows) if r], "names struct<sources:array<string>,kinds:array<string>>, uses array<struct<lo long, hi long, source string, kind string, epoch int>>")
    return narrow, table


def chosen(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (with names and h), once for each use; the table is bounded by MOST_PATTERNS."""
    joined = rows.join(F.broadcast(table), "names")
    return joined.withColumn("use", F.explode(F.filter("uses", lambda u: (u["lo"] <= F.col("h")) & (F.col("h") <= u["hi"]))))


def mixed(spark: SparkSession, docs: DataFrame, targets: dict[str, float] | None = None, kind_targets: dict[str, float] | None = None, budget: float = 1.0, epochs: int = 4, seed: int = 42, sources: Column | None = None, kinds: Column | None = None, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, kind, epoch, tokens) of the chosen documents, a row for each use;
    epoch is 0 for the first, source and kind are those it is used for.

    sources and kinds are arrays of names a document belongs to, by default its source and
    its language (repeats count once; a null name in the array doesn't count; pass sources
    alone for one layer). targets and kind_targets map names to weights, by default their
    tokens ** 0.5 each. Tokens are counted by the BPE of `path`; budget times the corpus's
    tokens is the sum of the quotas on either layer. A quota beyond `epochs` times what its
    documents have isn't met in full. The tokens chosen for a stretch of the flow differ
    from it by less than the documents at its ends.

    Documents of no source or kind, or with a null or empty text, are not chosen. A very
    long text is one document, never cut. A null doc_id is hashed like any value; rows that
    repeat doc_id and text share their fate. Other columns are not read. An empty table
    gives no rows.
    """
    sources, kinds = (source_names(), kind_names()) if sources is None else (sources, kinds)
    narrow, table = planned(spark, docs, targets, kind_targets, budget, epochs, seed, sources, kinds, path)
    return chosen(narrow, table).select("doc_id", F.col("use.source").alias("source"), F.col("use.kind").alias("kind"), F.col("use.epoch").alias("epoch"), "tokens")


def mixed_documents(spark: SparkSession, docs: DataFrame, targets: dict[str, float] | None = None, kind_targets: dict[str, float] | None = None, budget: float = 1.0, epochs: int = 4, seed: int = 42, sources: Column | None = None, kinds: Column | None = None, path: str = bpe.VOCABULARY) -> DataFrame:
    """The chosen documents with the columns of docs alone, once for each use; see mixed.
    The texts are read twice, to count tokens and to be chosen, and not shuffled."""
    sources, kinds = (source_names(), kind_names()) if sources is None else (sources, kinds)
    _, table = planned(spark, docs, targets, kind_targets, budget, epochs, seed, sources, kinds, path)
    pattern, h, usable = named(sources, kinds, seed)
    rows = docs.where(usable).select(F.struct("*").alias("weft_row"), pattern.alias("names"), h.alias("h"))
    return chosen(rows, table).select("weft_row.*")
