"""Byte CNN: against a plain convolution, held-out accuracy, and the cases of the columns."""

import os

import numpy as np
import pytest

from weftline.llm import bytecnn


def model(rng):
    return bytecnn.Model(rng.normal(0, 0.5, (256, bytecnn.DIMS)), rng.normal(0, 0.3, (bytecnn.WIDTH, bytecnn.DIMS, 4)), rng.normal(0, 0.1, 4).astype(np.float32), rng.normal(0, 1, 8), 0.1)


def plain(m, text):
    x = text or b"\0"
    pad = np.frombuffer(x + b"\0" * (bytecnn.WIDTH - 1), np.uint8)
    out = np.array([sum(m.embedding[pad[i + w]] @ m.filters[w] for w in range(bytecnn.WIDTH)) for i in range(len(x))])
    h = max(1, -(-len(x) // bytecnn.HALF))
    halves = [out[i * bytecnn.HALF : (i + 1) * bytecnn.HALF].max(axis=0) for i in range(h)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] if h > 1 else halves
    act = np.maximum(np.array(chunks) + m.bias, 0)
    return 1 / (1 + np.exp(-(np.concatenate([act.mean(axis=0), act.max(axis=0)]) @ m.weights + m.intercept)))


def test_whole_text_counts():
    rng = np.random.default_rng(0)
    m = model(rng)
    texts = [rng.integers(32, 127, n, dtype=np.uint8).tobytes() for n in (0, 1, 5, 255, 256, 257, 511, 512, 513, 1000, 5000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = bytecnn.probabilities(m, bytecnn.paired(m.tables()), data, offsets)
    assert np.allclose(got, [plain(m, t) for t in texts], atol=1e-4)


def test_one_class_rejects_nothing():
    assert bytecnn.train([b"a", b"b"], [True, True]).threshold == 0.0 and bytecnn.train([], []).threshold == 0.0


def test_cases(spark):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma"], 40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["$$%", "zzq", "#!x"], 40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + [(500, None), (501, ""), (None, good[0]), (502, good[1] * 3000), (0, good[0])]], "doc_id long, text string, probability double")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(None, 1), (3, None), (900, 1)], "doc_id long, quality int")
    m = bytecnn.fitted(docs, labels)
    got = bytecnn.scored(docs, m).collect()
    assert len(got) == len(rows) + 5 and {r["doc_id"]: (r["probability"], r["keep"]) for r in got}[500] == (None, False)
    held = [(r["doc_id"], r["keep"]) for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 120]
    assert held and not any(k for _, k in held)
    assert all(r["keep"] for r in got if r["doc_id"] in (502, None) or (r["doc_id"] or 999) < 60)
    kept = bytecnn.good_documents(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got)
    assert bytecnn.scored(docs.limit(0), m).count() == 0 and bytecnn.fitted(docs, labels.limit(0)).threshold == 0.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    train, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    m = bytecnn.fitted(docs, train)
    rows = bytecnn.scored(docs, m).join(rest, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad), (sum(good), len(good), sum(bad), len(bad))
