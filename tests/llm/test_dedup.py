"""Exact copies, near copies, fingerprints: against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import minhash, plumbing, recipes, simhash
from weftline.llm.textarrays import text_buffers


def rows_of(rng):
    long_ = " ".join(f"w{rng.random()}" for _ in range(9000))
    rows = [(i, f"text number {i % 7}") for i in range(20)] + [(100, long_), (101, long_), (102, long_ + "x"), (103, "x" + long_), (104, long_[:5000] + "Q" + long_[5001:])]
    return rows + [(200, ""), (201, ""), (202, None), (None, "text number 1"), (5, "another text of 5"), (5, "another text of 5"), (6, "text number 5"), (7, "é" * 9000), (8, "é" * 9000)]


def test_exact(spark):
    rows = rows_of(random.Random(3))
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, keep_id int, h string").repartition(4)
    texts = {(d, t) for d, t in rows if d is not None and t is not None}
    groups = {}
    for d, t in texts:
        groups.setdefault(t, []).append(d)
    want = sorted((d, min(g), len(g)) for g in groups.values() for d in g if d != min(g))
    assert sorted(map(tuple, recipes.duplicates(spark, df).collect())) == want
    kept = [(r["doc_id"], r["text"]) for r in recipes.without_copies(spark, df).collect()]
    expected = [(d, t) for d, t in texts if min(groups[t]) == d] + [(d, t) for d, t in rows if d is None or t is None]
    assert sorted(kept, key=repr) == sorted(expected, key=repr)
    assert recipes.without_copies(spark, df).columns == df.columns
    assert recipes.duplicates(spark, df.limit(0)).count() == 0 and recipes.without_copies(spark, df.limit(0)).count() == 0


def test_hash_collisions_are_told_apart():
    batch = pa.table({"h": [7, 7, 7], "doc_id": [3, 1, 2], "row": [0, 0, 0], "seq": pa.array([0, 0, 0], pa.int32()), "body": pa.array([b"a", b"b", b"a"]), "r_doc": pa.array([None] * 3, pa.int64()), "r_row": pa.array([None] * 3, pa.int64()), "r_seq": pa.array([None] * 3, pa.int32())})
    got = pa.Table.from_batches(list(recipes.verified_rows(iter(batch.to_batches()))))
    assert got["c_doc"].to_pylist() == [2, 1, 2]


def family(rng, n_base=60, n_near=4):
    vocabulary = [f"word{i}" for i in range(4000)]
    rows, d = [], 0
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 300))]
        for k in range(1 + rng.randint(0, n_near)):
            t = list(base)
            for _ in range(len(t) // 50 if k else 0):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((d, " ".join(t)))
            d += 1
    return rows


def components(n, edges):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_simhash_recall_against_brute_force(spark):
    rows = family(random.Random(5))
    fp, _ = simhash.fingerprints(*text_buffers(pa.array([t for _, t in rows])))
    gap = sum(np.bitwise_count(fp[:, None, i] ^ fp[None, :, i]).astype(int) for i in range(4))
    pairs = [(a, b) for a, b in zip(*np.nonzero(gap <= 52)) if a < b]
    label = components(len(rows), pairs)
    want = {d: label[d] for d in range(len(rows)) if label.count(label[d]) > 1}
    df = spark.createDataFrame([(*r, 0, 1) for r in rows + [(900, None), (901, "..."), (902, ""), (None, rows[0][1])]], "doc_id long, text string, list int, f0 int").repartition(3)
    got = dict(map(tuple, simhash.near_groups(spark, df).collect()))
    assert set(got) <= set(want)
    assert sum(got.get(d) == g for d, g in want.items()) >= 0.9 * len(want) and len(want) > 50
    small = dict(map(tuple, simhash.near_groups(spark, df, small=4).collect()))
    assert set(small) <= set(want) and sum(small.get(d) == g for d, g in want.items()) >= 0.9 * len(want)
    kept = simhash.one_of_each_group(spark, df)
    assert kept.columns == df.columns and {900, 901, 902} <= {r["doc_id"] for r in kept.collect()}
    assert kept.count() == df.count() - sum(d != g for d, g in got.items())
    assert simhash.near_groups(spark, df.limit(0)).count() == 0


def test_simhash_of_repeated_ids(spark):
    text = " ".join(f"some{i}" for i in range(50))
    df = spark.createDataFrame([(3, text), (3, text), (1, text), (2, "quite different words here")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_groups(spark, df).collect())) == [(1, 1), (3, 1)]
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(spark, df).collect()) == [1, 2]


def flipped(rng, base, n, bits):
    """n copies of a fingerprint with exactly that many other bits flipped in each."""
    where = np.argsort(rng.random((n, simhash.BITS)), axis=1)[:, :bits]
    out = np.repeat(base[None], n, axis=0)
    for k in range(bits):
        np.bitwise_xor.at(out, (np.arange(n), where[:, k] // 64), np.uint64(1) << (where[:, k] % 64).astype(np.uint64))
    return out


def test_a_large_family_takes_linear_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    fp = flipped(rng, rng.integers(0, 2**63, 4, dtype=np.uint64), 100_000, 15)
    ids = rng.permutation(100_000) + 11
    tracemalloc.start()
    a, b = simhash.close_in_list(ids, fp, 52, 1024, simhash.repeats_for(52 / 256, 0.92), 1)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and len(a) == 99_999 and set(b.tolist()) == {11}
    tracemalloc.stop()


@pytest.mark.parametrize("small", [16, 64])
def test_recall_of_pairs_at_the_radius_within_long_lists(small):
    """Lists far beyond `small`, so that each pair has to be found one or more levels down."""
    rng = np.random.default_rng(4)
    first = rng.integers(0, 2**63, (700, 4), dtype=np.uint64)
    second = np.concatenate([flipped(rng, f, 1, 52) for f in first])
    a, b = simhash.close_in_list(np.arange(1400), np.concatenate([first, second]), 52, small, simhash.repeats_for(52 / 256, 0.92), 9)
    found = sum((x, y) == (i + 700, i) for x, y in zip(a.tolist(), b.tolist()) for i in [y])
    assert found >= 0.92 * 700 - 2 * (700 * 0.92 * 0.08) ** 0.5


def test_lists_just_over_small_are_cut_in_few_steps(monkeypatch):
    """A long list falls into thousands of lists of a few nodes; they aren't searched one by one."""
    steps = []
    for name in ("search", "compare"):
        plain = getattr(simhash.ListSearch, name)
        monkeypatch.setattr(simhash.ListSearch, name, lambda self, *a, plain=plain: (steps.append(1), plain(self, *a))[1])
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**63, (1500, 4), dtype=np.uint64)
    fp[1000:] = [flipped(rng, f, 1, 30)[0] for f in fp[:500]]
    a, b = simhash.close_in_list(np.arange(1500), fp, 52, 1024, simhash.repeats_for(52 / 256, 0.92), 1)
    assert len(steps) < 10
    assert set(zip(a.tolist(), b.tolist())) <= {(i + 1000, i) for i in range(500)} and len(a) >= 490


@pytest.mark.parametrize("short", [1, 3, 256])
def test_short_lists_are_compared_pair_by_pair(monkeypatch, short):
    """On one strip, whichever lists count as short: the components of the pairs that share a list."""
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    fp = np.concatenate([flipped(rng, base[rng.integers(40)], 1, int(rng.integers(1, 45))) for _ in range(600)])
    keys = simhash.strip_centres(fp, 9 * 128 + 1)
    pairs = [(x, y) for x, y in zip(*np.nonzero(simhash.distances(fp[:, None], fp[None, :]) <= 52)) if x < y and keys[x] == keys[y]]
    label = components(len(fp), pairs)
    a, b = simhash.close_in_list(np.arange(len(fp)), fp, 52, 300, 1, 9)
    assert dict(zip(a.tolist(), b.tolist())) == {i: g for i, g in enumerate(label) if g != i}


def test_stars_give_exact_components_at_the_last_level(monkeypatch):
    monkeypatch.setattr(simhash, "DEEPEST", 0)
    rng = np.random.default_rng(5)
    chain = [rng.integers(0, 2**63, 4, dtype=np.uint64)]
    for _ in range(150):
        chain.append(flipped(rng, chain[rng.integers(len(chain))], 1, int(rng.integers(10, 60)))[0])
    fp = np.concatenate([np.array(chain), rng.integers(0, 2**63, (50, 4), dtype=np.uint64)])
    gap = simhash.distances(fp[:, None], fp[None, :])
    label = components(len(fp), [(x, y) for x, y in zip(*np.nonzero(gap <= 52)) if x < y])
    a, b = simhash.close_in_list(np.arange(len(fp)), fp, 52, 8, 3, 2)
    assert dict(zip(a.tolist(), b.tolist())) == {i: g for i, g in enumerate(label) if g != i}


def test_every_fingerprint_has_one_centre():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, (500, 4), dtype=np.uint64)
    coords, shift = simhash.strip(3)
    own = simhash.strip_centres(fp, 3)
    for f, c in zip(fp, own):
        x = shift
        for i, k in enumerate(coords.tolist()):
            x ^= int((int(f[k // 64]) >> (k % 64)) & 1) << i
        assert bin(x ^ int(c)).count("1") <= 1
        s = 0
        for i in range(simhash.STRIP):
            s ^= ((int(c) >> i) & 1) * (i + 1)
        assert s == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    label = components(500, edges)
    want = {(a, label[a]) for e in edges if e[0] != e[1] for a in e}
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    assert {tuple(r) for r in plumbing.connected_components(spark, df).distinct().collect()} == want
    assert plumbing.connected_components(spark, df.limit(0)).count() == 0


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_minhash_estimates_jaccard(spark):
    rng = random.Random(2)
    base = [f"w{rng.random()}" for _ in range(600)]
    rows = [(k, " ".join(base[: 600 - 60 * k] + [f"v{k}{i}" for i in range(60 * k)])) for k in range(8)]
    df = spark.createDataFrame([(*r, b"") for r in rows + [(50, "a b"), (51, "a b"), (52, ""), (53, None), (None, "a b")]], "doc_id long, text string, signature binary")
    got = {r["doc_id"]: r for r in minhash.fingerprints(df, 512).collect()}
    assert got[52]["signature"] is None and got[53]["n_shingles"] == 0 and got[50]["signature"] == got[51]["signature"] == got[None]["signature"]
    for k in range(1, 8):
        a, b = shingles(rows[0][1]), shingles(rows[k][1])
        assert abs(minhash.jaccard(got[0]["signature"], got[k]["signature"], 8) - len(a & b) / len(a | b)) < 0.1
    assert len(got[0]["signature"]) == 512 and got[0]["chance"] == 2.0**-8
    found = minhash.fingerprints(df, 512).select("doc_id", "signature")
    both = found.where("doc_id = 0").selectExpr("signature AS a").crossJoin(found).select("doc_id", minhash.similarity(F.col("a"), F.col("signature")).alias("j"))
    assert {r["doc_id"]: r["j"] for r in both.collect()} == {d: r["signature"] and minhash.jaccard(got[0]["signature"], r["signature"], 8) for d, r in got.items()}
    assert minhash.fingerprints(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.fingerprints(df, 100)


def test_very_long_texts(spark):
    long_ = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long_), (2, long_ + " more"), (3, "w1 w2 w3")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_groups(spark, df).collect())) == [(1, 1), (2, 1)]
    got = {r["doc_id"]: r for r in minhash.fingerprints(df).collect()}
    assert got[1]["n_shingles"] == 199_996 and minhash.jaccard(got[1]["signature"], got[2]["signature"], 8) > 0.9


def test_densification_against_a_plain_loop():
    rng = np.random.default_rng(4)
    bins = 64
    h = rng.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2)
    got, filled = minhash.signatures(h, np.array([0, 20, 20]), bins)
    own = {}
    for x in h.tolist():
        b = x >> 58
        own[b] = min(own.get(b, 2**64), x & ((1 << 58) - 1))
    for i in range(bins):
        t, d = 0, i
        while d not in own:
            d = int(minhash.donors(bins, t)[i])
            t += 1
        assert int(got[0, i]) == own[d]
    assert filled.tolist() == [len(own), 0] and (got[1] == minhash.NONE).all()
    assert minhash.unpacked(minhash.packed(got[:1], 5).tobytes(), 5).tolist() == [int(v) & 31 for v in got[0]]
