"""Search over page rows: keywords, vectors, both; look-ups and listings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.functions import text
from weftline.sources.tables import kept, small_batches


def keyword_hits(df: DataFrame, query: str) -> DataFrame:
    """Rows with score, the number of the query's words found anywhere in title or text."""
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    score = F.lit(0)
    for w in query.lower().split():
        score = score + F.contains(hay, F.lit(w)).cast("int")
    return df.withColumn("score", score).where("score > 0")


def keyword_search(df: DataFrame, query: str, most: int = 10, order: str = "url", before: int = 100, after: int = 100) -> DataFrame:
    """The best hits with a snippet; equal scores in the given order. The snippet is cut only
    for the rows that are returned."""
    best = keyword_hits(df, query).orderBy(F.desc("score"), order).limit(most)
    return best.withColumn("snippet", text.snippet(F.col("text"), query.lower().split(), before, after))


def find_page(df: DataFrame, url: str, order: str = "url") -> DataFrame:
    """The first row of that address; case and a final slash don't count."""
    plain = lambda c: F.regexp_replace(F.lower(c), "/+$", "")
    return df.where(plain(F.col("url")) == plain(F.lit(url))).orderBy(order).limit(1)


def listing(df: DataFrame) -> DataFrame:
    return df.select("url", F.coalesce("title", F.lit("Untitled")).alias("title"), text.word_count(F.coalesce("text", F.lit(""))).alias("words"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, in double; null if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def nearest(df: DataFrame, vector: list[float], most: int = 10, column: str = "embedding", order: str = "id") -> DataFrame:
    """The rows of highest cosine similarity to one vector."""
    v = F.array(*(F.lit(float(x)) for x in vector))
    size = F.lit(sum(float(x) ** 2 for x in vector) ** 0.5)
    own = F.sqrt(dot(F.col(column), F.col(column)))
    return df.withColumn("similarity", F.when(own * size > 0, dot(F.col(column), v) / (own * size))).orderBy(F.desc_nulls_last("similarity"), order).limit(most)


def ranked(pairs: DataFrame, query: str, similarity: str, order: str) -> DataFrame:
    """pairs with rank: place of each candidate among its query's, the most alike first."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(similarity), order)))


def blocks_of_spans(spans: DataFrame, most: int) -> Iterator[dict[str, set[str]]]:
    """{span: keys} of spans (weft_span, weft_key) in blocks of about `most` characters."""
    block, size = {}, 0
    for r in spans.toLocalIterator():
        block.setdefault(r["weft_span"], set()).add(r["weft_key"])
        size += len(r["weft_span"])
        if size > most:
            yield block
            block, size = {}, 0
    if block:
        yield block


def contained(block: dict[str, set[str]], kind: pa.DataType):
    """A pass over (text, key, index) that gives (span, key, least index) of the spans of the
    block found in the texts, a row at most for each in a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for span in block:
            if span:
                known.add_word(span, span)
        known.make_automaton()
        least: dict[tuple[str, str], object] = {}
        for batch in batches:
            index = batch.column(2).to_pylist()
            for text_, key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), index):
                here = {span for _, span in known.iter(text_)} if len(known) else set()
                for span in here | {""} if "" in block else here:
                    if key in block[span] and ((span, key) not in least or i < least[span, key]):
                        least[span, key] = i
        cells = list(least.items())
        yield pa.RecordBatch.from_arrays([pa.array([s for (s, _), _ in cells], pa.string()), pa.array([k for (_, k), _ in cells], pa.string()), pa.array([i for _, i in cells], kind)], ["weft_span", "weft_key", "first_index"])

    return rows


def first_containing(spans: DataFrame, chunks: DataFrame, span: str, chunk: str, index: str, on: list[str] | None = None, most: int = 1 << 22) -> DataFrame:
    """For each span the least index of a chunk that contains it, case apart; spans found
    nowhere, and null ones, have a null one. With `on`, both must agree on those columns,
    nulls included. Chunks without a text or an index don't count.

    The spans are the query set: in blocks of `most` characters they become an automaton
    (Aho-Corasick) that finds all of them in one pass over the chunks, so nothing is joined
    but the hits, a row for each span and task."""
    key = F.coalesce(F.to_json(F.struct(*on)), F.lit("")) if on else F.lit("")
    asked = spans.where(F.col(span).isNotNull()).select(F.lower(span).alias("weft_span"), key.alias("weft_key")).distinct()
    given = chunks.where(F.col(chunk).isNotNull() & F.col(index).isNotNull()).select(F.lower(chunk).alias("weft_text"), key.alias("weft_key"), F.col(index).alias("first_index"))
    kind = given.schema["first_index"].dataType
    schema = f"weft_span string, weft_key string, first_index {kind.simpleString()}"
    small_batches(chunks.sparkSession)
    found = [given.mapInArrow(contained(b, to_arrow_type(kind)), schema) for b in blocks_of_spans(asked, most)]
    if not found:
        return spans.distinct().withColumn("first_index", F.lit(None).cast(kind))
    hits = reduce(DataFrame.unionByName, found).groupBy("weft_span", "weft_key").agg(F.min("first_index").alias("first_index"))
    own = spans.distinct().withColumns({"weft_lower": F.lower(span), "weft_own": key})
    return own.join(hits, (own["weft_lower"] == hits["weft_span"]) & (own["weft_own"] == hits["weft_key"]), "left").select(*(own[c] for c in spans.columns), "first_index")


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, their lengths, unit vectors in single precision) of a column of arrays; a null
    vector has zeros, and one with a cell that is no number counts as without length."""
    vectors = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(vectors)
    wide = pc.max(sizes).as_py() or 1
    if vectors.null_count or pc.min(sizes).as_py() != wide:
        m = np.array([np.zeros(wide) if v is None else v for v in vectors.to_pylist()], dtype=np.float64).reshape(len(vectors), wide)
    else:
        m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), wide)
    size = np.sqrt((m * m).sum(axis=1))
    size = np.where(np.isfinite(size), size, 0.0)
    m[size == 0] = 0.0
    return m, size, (m / np.where(size > 0, size, 1.0)[:, None]).astype(np.float32)


NO_LENGTH, SELF = -2.0, -3.0  # in place of a similarity


class Pairs:
    """Similarities of queries to candidates in strips: in single precision, whose error is
    less than `slack` with that of the rounding to 6 places, and exact where that leaves
    something open. Candidates are in the order of their ids."""

    def __init__(self, q: pa.Table, c: pa.Table):
        c = c.take(pc.sort_indices(c["id"]))
        self.ids, self.c_ids = q["id"], c["id"]
        (self.a, self.sa, self.ua), (self.b, self.sb, self.ub) = matrix(q["vector"]), matrix(c["vector"])
        self.slack = (self.a.shape[1] + 8) * 6e-8 + 1e-6
        own, ids = q["id"].to_numpy(), c["id"].to_numpy()
        self.first, self.last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        self.same = np.flatnonzero(self.last > self.first)
        self.blank = np.flatnonzero(self.sb == 0)

    def strip(self, lo: int, hi: int, at: int, to: int) -> np.ndarray:
        """Queries lo to hi by candidates at to `to`."""
        s = self.ua[lo:hi] @ self.ub[at:to].T
        blank = self.blank[(self.blank >= at) & (self.blank < to)]
        if len(blank):
            s[:, blank - at] = NO_LENGTH
        s[self.sa[lo:hi] == 0] = NO_LENGTH
        for r in self.same[(self.same >= lo) & (self.same < hi)]:
            s[r - lo, max(self.first[r] - at, 0) : max(self.last[r] - at, 0)] = SELF
        return s

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for lo in range(0, len(r), 1 << 15):
            i, j = r[lo : lo + (1 << 15)], c[lo : lo + (1 << 15)]
            size = self.sa[i] * self.sb[j]
            out[lo : lo + len(i)] = np.where(size > 0, np.round((self.a[i] * self.b[j]).sum(axis=1) / np.where(size > 0, size, 1.0), 6), NO_LENGTH)
        return out

    def best(self, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, similarity, candidate) of the nearest candidate, the first of equals."""
        wide, found = len(self.sb), []
        high = max(1, cells // wide)
        for lo in range(0, len(self.sa), high):
            s = self.strip(lo, lo + high, 0, wide)
            top = s.max(axis=1)
            r, c = np.divmod(np.flatnonzero((s >= (top - 2 * self.slack)[:, None]) & (s > SELF)), wide)
            r += lo
            exact = self.exact(r, c)
            order = np.lexsort((c, -exact, r))
            r, first = np.unique(r[order], return_index=True)
            found.append((r, exact[order][first], c[order][first]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def ahead(self, mine: np.ndarray, match: np.ndarray, high: int = 256, wide: int = 4096) -> np.ndarray:
        """For each query the candidates before its match: more alike than `mine`, or as much with a lesser id."""
        place = np.searchsorted(self.c_ids.to_numpy(), match, "left")
        n = np.zeros(len(mine), dtype=np.int64)
        over, under = ((mine + x).astype(np.float32)[:, None] for x in (self.slack, -self.slack))
        for lo in range(0, len(mine), high):
            for at in range(0, len(self.sb), wide):
                s = self.strip(lo, lo + high, at, at + wide)
                sure = s > over[lo : lo + high]
                n[lo : lo + high] += [np.count_nonzero(x) for x in sure]
                r, c = np.divmod(np.flatnonzero(sure ^ (s >= under[lo : lo + high])), s.shape[1])
                r, c = r + lo, c + at
                exact = self.exact(r, c)
                n += np.bincount(r[(exact > mine[r]) | ((exact == mine[r]) & (c < place[r]))], minlength=len(n))
        return n


def match_ranks(df: DataFrame, block: int = 1 << 16, chosen: Column | None = None) -> DataFrame:
    """(query_id, query_label, rank) of every vector of (id, vector, label) as a query, or of
    those that `chosen` says, against all: the place of the nearest other vector with its
    label, by cosine to 6 places, then id; null without one. Blocks of at most about that many
    vectors are compared in pairs: those of a label for the nearest match, then all to count
    what is nearer. A vector without length is behind all others."""
    spark = df.sparkSession
    queries = df if chosen is None else df.where(chosen)
    total = df.count()
    asking = total if chosen is None else queries.count()
    pairs = 3 * spark.sparkContext.defaultParallelism  # fewer would leave cores idle
    most = lambda n: max(1, -(-n // min(block, 2048)))
    across = max(1, -(-asking // block), min(most(asking), math.isqrt(pairs - 1) + 1))
    down = max(1, -(-total // block), min(most(total), -(-pairs // across)))
    kind = df.schema["id"].dataType
    arrow = to_arrow_type(kind)
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def nearest_of_label(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, near, match = [pa.array([], arrow)], [np.empty(0)], [pa.array([], arrow)]
        of = lambda t: t["label"].combine_chunks().dictionary_encode() if t.num_rows else None
        mine, others = of(q), of(c)
        if mine is not None and others is not None:
            mine, others = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (mine, others))
            place = pc.index_in(mine.dictionary, others.dictionary).to_numpy(zero_copy_only=False)
            for k, at in enumerate(place):
                if at == at:
                    p = Pairs(q.filter(pc.equal(mine.indices, k)), c.filter(pc.equal(others.indices, int(at))))
                    r, s, j = p.best()
                    ids, near, match = [*ids, *p.ids.take(pa.array(r)).chunks], [*near, s], [*match, *p.c_ids.take(pa.array(j)).chunks]
        return pa.table({"id": pa.chunked_array(ids, arrow), "s": pa.array(np.concatenate(near)), "i": pa.chunked_array(match, arrow)})

    def nearer(q: pa.Table, c: pa.Table) -> pa.Table:
        n = Pairs(q, c).ahead(q["s"].to_numpy(), q["i"].to_numpy()) if q.num_rows and c.num_rows else np.zeros(q.num_rows, dtype=np.int64)
        return pa.table({"id": q["id"], "n": pa.array(n, pa.int64())})

    def copied(table: DataFrame) -> DataFrame:
        """Else the two sides of a join share their columns' ids."""
        return table.select(*(F.col(c).alias(c) for c in table.columns))

    # The pairs within labels: many small labels share a bucket, a large one is cut into parts.
    within = max(1, block // 4)
    labels = df.where("label is not null").groupBy("label").agg(F.ceil(F.count("*") / within).alias("parts"))
    bucket = F.pmod(F.xxhash64("label"), F.lit(max(pairs, -(-total // within)))).alias("bucket")
    named = lambda t: t.select("id", "label", "vector").join(copied(labels), "label")
    left = named(queries).select("id", "label", "vector", bucket, part(F.col("parts")).alias("x"), every(F.col("parts")).alias("y"))
    right = named(copied(df)).select("id", "label", "vector", bucket, part(F.col("parts")).alias("y"), every(F.col("parts")).alias("x"))
    first = left.groupBy("bucket", "x", "y").cogroup(right.groupBy("bucket", "x", "y")).applyInArrow(nearest_of_label, f"id {kind.simpleString()}, s double, i {kind.simpleString()}")
    first = first.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("s"), "i")).alias("m")).select("id", (-F.col("m.s")).alias("s"), F.col("m.i").alias("i"))

    asked = queries.select("id", "vector").join(first, "id").select("id", "vector", "s", "i", part(F.lit(across)).alias("x"), every(F.lit(down).cast("long")).alias("y"))
    all_ = copied(df).select("id", "vector", part(F.lit(down)).alias("y"), every(F.lit(across).cast("long")).alias("x"))
    counts = asked.groupBy("x", "y").cogroup(all_.groupBy("x", "y")).applyInArrow(nearer, f"id {kind.simpleString()}, n long")
    counts = counts.groupBy("id").agg((F.sum("n") + 1).alias("rank"))
    return copied(queries).select("id", "label").join(counts, "id", "left").select(F.col("id").alias("query_id"), F.col("label").alias("query_label"), "rank")


def rank_metrics(df: DataFrame, rank: str = "rank", by: str | None = None) -> DataFrame:
    """queries, mrr (reciprocals rounded to 4 before the mean), hits at 1, 5 and 10, misses;
    a null rank counts as a miss."""
    r = F.coalesce(F.round(1.0 / F.col(rank), 4), F.lit(0.0))
    hits = [F.count_if(F.col(rank) <= k).alias(f"hit_{k}") for k in (1, 5, 10)]
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.count("*").alias("queries"), F.round(F.avg(r), 4).alias("mrr"), *hits, F.count_if(F.col(rank).isNull()).alias("misses"))


def spread_sample(df: DataFrame, k: int, source: str = "_source", order: str = "url") -> DataFrame:
    """k rows spread over the sources: a fair share of each, filled up in order from the rest."""
    n = df.select(source).distinct().count()
    share = max(1, k // max(n, 1))
    own = df.withColumn("weft_n", F.row_number().over(Window.partitionBy(source).orderBy(order)))
    own = own.where(F.col("weft_n") <= k)  # no later row can be among k; tasks cut their part of a source before the shuffle
    late = F.when(F.col("weft_n") > share, 1).otherwise(0)
    return own.orderBy(late, source if n > 1 else order, order).limit(k).drop("weft_n") if n > 1 else df.orderBy(order).limit(k)


def bm25(spark, chunks: DataFrame, query: str, key: str = "id", body: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, bm25) of the rows that hold a word of the query: Okapi BM25 over white-space
    tokens in lower case, idf = ln(1 + (N - n + 0.5) / (n + 0.5)). A word repeated in the
    query counts as often. Statistics are counted over all rows."""
    asked: dict[str, int] = {}
    for w in query.lower().split():
        asked[w] = asked.get(w, 0) + 1
    # The tokens are a column of their own, so that a row is split once for all words.
    tokens = chunks.where(F.col(body).isNotNull()).select(key, text.words(F.lower(F.col(body))).alias("weft_tokens"))
    times = lambda w: F.size(F.filter("weft_tokens", lambda t: t == F.lit(w)))
    counts = [times(w).alias(f"tf{i}") for i, w in enumerate(asked)]
    rows = kept(spark, tokens.select(key, F.size("weft_tokens").alias("n"), *counts), "bm25")
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))))
    score = F.lit(0.0)
    for i, weight in enumerate(asked.values()):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean"))) * weight
    some = F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{i}") for i in range(len(asked)))) > 0
    return rows.where(some).crossJoin(F.broadcast(stats)).select(key, score.alias("bm25"))


# Weight of the vectors in hybrid retrieval by kind of site; 1 is vectors alone. Words help
# where questions name technical terms, and harm where product names are noise.
RECIPES = {"apiref": 1.0, "blog": 1.0, "docs": 1.0, "docs-names": 0.7, "ecom": 1.0, "spa": 1.0, "wiki": 1.0}


def alpha_for(category: str | None) -> float:
    """The recipe's weight for a kind of site, 1 for one that isn't known."""
    return RECIPES.get(category or "", 1.0)


def hybrid(spark, chunks: DataFrame, query: str, vector: list[float], alpha: float = 0.7, most: int = 10, key: str = "id", body: str = "text", column: str = "embedding") -> DataFrame:
    """Blend of cosine and BM25, each spread over 0 to 1 (0 where all are equal)."""
    v = F.array(*(F.lit(float(x)) for x in vector))
    lexical = bm25(spark, chunks, query, key, body)
    both = chunks.where(F.col(body).isNotNull()).select(key, F.coalesce(cosine(F.col(column), v), F.lit(0.0)).alias("cosine")).join(lexical, key, "left").fillna(0.0, ["bm25"])
    edges = both.agg(*(f(c).alias(f"{n}_{c}") for c in ("cosine", "bm25") for n, f in (("lo", F.min), ("hi", F.max))))
    unit = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    score = alpha * unit("cosine") + (1 - alpha) * unit("bm25")
    return both.crossJoin(F.broadcast(edges)).select(key, score.alias("score"), "cosine", "bm25").orderBy(F.desc("score"), key).limit(most)
