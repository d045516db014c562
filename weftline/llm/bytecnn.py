"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned embedding; `filters` learned filters of six bytes slide over the
whole text. Their outputs are max-pooled over chunks of 512 bytes that overlap by half,
so that every byte is in two chunks (but for the ends). The document's features are, for
each filter, the mean and the maximum over its chunks of the rectified pool, and a
logistic unit combines them into one probability of good quality.

The first layer is linear in one-hot bytes, so it is a table of 256 x filters numbers for
each of the six offsets, looked up and added; for scoring, tables of two bytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.plumbing import small_batches
from weftline.llm.textarrays import pieces

WIDTH, HALF, DIMS = 6, 256, 8


@dataclass
class Model:
    embedding: np.ndarray  # (256, DIMS)
    filters: np.ndarray  # (WIDTH, DIMS, filters)
    bias: np.ndarray  # (filters,)
    weights: np.ndarray  # (2 * filters,)
    intercept: float
    threshold: float = 0.5

    def tables(self) -> np.ndarray:
        return np.einsum("bd,wdf->wbf", self.embedding, self.filters).astype(np.float32)


def convolved(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Filter outputs at each of len(data) - WIDTH + 1 positions."""
    n = len(data) - WIDTH + 1
    out = tables[0].take(data[:n], axis=0)
    for w in range(1, WIDTH):
        out += tables[w].take(data[w : w + n], axis=0)
    return out


def paired(tables: np.ndarray) -> np.ndarray:
    """The tables of two neighbouring bytes at once: 65536 x filters for each of WIDTH / 2 pairs."""
    return (tables[0::2, :, None] + tables[1::2, None, :]).reshape(WIDTH // 2, 65536, -1)


def convolved_pairs(pairs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The outputs of `convolved` by the tables of `paired`, with half the look-ups."""
    n = len(data) - WIDTH + 1
    two = data[:-1].astype(np.intp) << 8 | data[1:]
    out = pairs[0].take(two[:n], axis=0)
    for k in range(1, WIDTH // 2):
        out += pairs[k].take(two[2 * k : 2 * k + n], axis=0)
    return out


def halves(lengths: np.ndarray) -> np.ndarray:
    """Half chunks of each text: one for each HALF positions begun, one at least."""
    return np.maximum(1, -(-lengths // HALF))


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text followed by WIDTH - 1 zero bytes, so that a filter starts at each byte; an
    empty text becomes one zero byte more."""
    lengths = np.diff(offsets)
    room = np.maximum(lengths, 1) + WIDTH - 1
    at = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(at[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], lengths)] = data
    return out, at


def probabilities(model: Model, pairs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of good quality of each text of the buffer; pairs are the model's paired tables."""
    lengths = np.maximum(np.diff(offsets), 1)
    flat, at = padded(data, offsets)
    n_half = halves(lengths)
    starts = np.repeat(at[:-1], n_half) + HALF * (np.arange(n_half.sum()) - np.repeat(np.cumsum(n_half) - n_half, n_half))
    ends = np.minimum(starts + HALF, np.repeat(at[:-1] + lengths, n_half))
    pool = np.empty((len(starts), len(model.bias)), np.float32)
    i = 0
    while i < len(starts):  # about 4096 positions at a time, whose outputs stay in the cache
        j = int(np.searchsorted(starts, starts[i] + (1 << 12)))
        out = convolved_pairs(pairs, flat[starts[i] : ends[j - 1] + WIDTH - 1])
        cuts = np.stack([starts[i:j], ends[i:j]], axis=1).ravel() - starts[i]
        pool[i:j] = np.maximum.reduceat(out, cuts[:-1], axis=0)[::2]
        i = j
    last = np.cumsum(n_half)
    chunk = pool.copy()
    chunk[:-1] = np.maximum(pool[:-1], pool[1:])
    single = n_half == 1
    chunk[last - 1] = pool[last - 1]
    drop = np.zeros(len(pool), bool)
    drop[(last - 1)[~single]] = True  # the last half chunk is in the chunk before it
    kept = np.maximum(chunk[~drop] + model.bias, 0)
    firsts = np.concatenate([[0], np.cumsum(np.maximum(1, n_half - 1))])[:-1]
    counts = np.maximum(1, n_half - 1)[:, None]
    feats = np.concatenate([np.add.reduceat(kept, firsts, axis=0) / counts, np.maximum.reduceat(kept, firsts, axis=0)], axis=1)
    return 1 / (1 + np.exp(-np.clip(feats @ model.weights + model.intercept, -30, 30)))


def train(texts: list[bytes], good: list[bool], filters: int = 16, epochs: int = 12, seed: int = 7, lose: float = 0.001) -> Model:
    """Adam on the weighted log loss, both classes with equal total weight. The threshold
    is set so that at most the share `lose` of the good texts lies below it, and is 0.5 at
    most. With one class only, the model says 0.5 for every text and rejects nothing."""
    rng = np.random.default_rng(seed)
    p = {"embedding": rng.normal(0, 0.5, (256, DIMS)), "filters": rng.normal(0, 0.3, (WIDTH, DIMS, filters)), "bias": np.zeros(filters), "weights": rng.normal(0, 0.3, 2 * filters), "intercept": np.zeros(1)}
    y = np.array(good, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(p["embedding"], p["filters"], p["bias"], np.zeros(2 * filters), 0.0, 0.0)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 16):
            g = {k: np.zeros_like(x) for k, x in p.items()}
            tables = np.einsum("bd,wdf->wbf", p["embedding"], p["filters"]).astype(np.float32)
            g_tables = np.zeros(tables.shape)
            batch = order[lo : lo + 16]
            for i in batch.tolist():
                raw = np.frombuffer(texts[i], np.uint8)
                flat, _ = padded(raw, np.array([0, len(raw)]))
                out = convolved(tables, flat)
                h = -(-len(out) // HALF)
                full = np.full((h * HALF, filters), -np.inf, np.float32)
                full[: len(out)] = out
                full = full.reshape(h, HALF, filters)
                where = full.argmax(axis=1) + np.arange(h)[:, None] * HALF
                pool = full.max(axis=1)
                if h > 1:
                    second = pool[1:] > pool[:-1]
                    where, pool = np.where(second, where[1:], where[:-1]), np.maximum(pool[1:], pool[:-1])
                act = np.maximum(pool + p["bias"], 0)
                top = act.argmax(axis=0)
                feats = np.concatenate([act.mean(axis=0), act.max(axis=0)])
                prob = 1 / (1 + np.exp(-np.clip(feats @ p["weights"] + p["intercept"][0], -30, 30)))
                d = (prob - y[i]) * share[i] / len(batch)
                g["weights"] += d * feats
                g["intercept"] += d
                g_act = np.tile(d * p["weights"][:filters] / len(act), (len(act), 1))
                g_act[top, np.arange(filters)] += d * p["weights"][filters:]
                g_act *= act > 0
                g["bias"] += g_act.sum(axis=0)
                f = np.broadcast_to(np.arange(filters), where.shape)
                for w in range(WIDTH):
                    np.add.at(g_tables[w], (flat[where + w], f), g_act)
            g["filters"] = np.einsum("bd,wbf->wdf", p["embedding"], g_tables) + 1e-4 * p["filters"]
            g["embedding"] = np.einsum("wdf,wbf->bd", p["filters"], g_tables) + 1e-4 * p["embedding"]
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    model = Model(p["embedding"], p["filters"], p["bias"].astype(np.float32), p["weights"], float(p["intercept"][0]))
    pairs = paired(model.tables())
    scores = np.array([probabilities(model, pairs, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t, ok in zip(texts, good) if ok])
    model.threshold = float(min(0.5, np.quantile(scores, lose)))
    return model


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 3000, **options) -> Model:
    """A model fitted to the texts of at most `sample` labelled documents, those whose
    doc_id comes first by hash; texts count whole. Rows with a null label, doc_id or text
    are left out, as are labels without a document; a doc_id labelled more than once
    counts with its least label."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    spark = docs.sparkSession
    if not len(chosen):
        return train([], [], **options)
    few = spark.createDataFrame(chosen)
    rows = docs.where("text is not null").select(docs["doc_id"].alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("d") == few["doc_id"]).select("d", "quality", "text").toArrow()
    rows = rows.to_pandas().sort_values(["d", "text"])
    return train([t.encode() for t in rows["text"]], [q == 1 for q in rows["quality"]], **options)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, probability, keep) of every row of docs. A null text has a null probability
    and is not kept; an empty one is scored as a single zero byte, a very long one over all
    its chunks; a probability at the threshold is kept. A null doc_id stays null, repeated
    rows have a result each, other columns are not read, an empty table gives no rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = paired(model.tables())
        for batch, data, offsets in pieces(batches, "text"):
            p = probabilities(model, pairs, data, offsets)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, mask=null), pa.array((p >= model.threshold) & ~null)], ["doc_id", "probability", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, probability double, keep boolean")


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model keeps, all columns passed through whatever they are
    called; one pass without a shuffle. Rows with a null text are rejected."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def keep(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs = paired(model.tables())
        for column in texts:
            out = [np.zeros(0, bool)]
            for _, data, offsets in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                out.append(probabilities(model, pairs, data, offsets) >= model.threshold)
            yield pa.array(np.concatenate(out))

    return docs.where(F.col("text").isNotNull()).where(keep(F.col("text").cast("string")))
