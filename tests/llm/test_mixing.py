"""Mixing: the flow against linear search, and the selection against its flow and its quotas."""

import itertools
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, queries

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")


def cheapest(capacity, members, quota, epochs):
    """(flow, cost) of the best assignment of tokens, by trying all."""
    cells = [(p, c) for p, own in enumerate(members) for c in own]
    best = (0, 0)
    for amounts in itertools.product(*(range(min(quota[c], epochs * capacity[p]) + 1) for p, c in cells)):
        used = [sum(a for a, (p, _) in zip(amounts, cells) if p == k) for k in range(len(capacity))]
        if any(u > epochs * c for u, c in zip(used, capacity)) or any(sum(a for a, (_, c) in zip(amounts, cells) if c == k) > q for k, q in enumerate(quota)):
            continue
        cost = sum(max(0, min(u - k * cap, cap)) * k * k for u, cap in zip(used, capacity) for k in range(epochs))
        best = max(best, (sum(amounts), -cost))
    return best[0], -best[1]


def cheapest_of_two_layers(capacity, members, quota, kinds, kind_quota, epochs):
    """The same where each use serves a source and a kind, over all amounts of all triples."""
    cells = [(p, c, d) for p in range(len(capacity)) for c in members[p] for d in kinds[p]]
    best = (0, 0)
    for amounts in itertools.product(*(range(min(quota[c], kind_quota[d], epochs * capacity[p]) + 1) for p, c, d in cells)):
        took = lambda k, i: sum(a for a, cell in zip(amounts, cells) if cell[k] == i)
        used = [took(0, p) for p in range(len(capacity))]
        if any(u > epochs * c for u, c in zip(used, capacity)) or any(took(1, c) > q for c, q in enumerate(quota)) or any(took(2, d) > q for d, q in enumerate(kind_quota)):
            continue
        cost = sum(max(0, min(u - k * cap, cap)) * k * k for u, cap in zip(used, capacity) for k in range(epochs))
        best = max(best, (sum(amounts), -cost))
    return best[0], -best[1]


@pytest.mark.parametrize(("capacity", "members", "quota"), [([2, 1], [[0], [0, 1]], [3, 2]), ([1, 2], [[0, 1], [1]], [2, 4]), ([3], [[0, 1]], [1, 1]), ([1, 1], [[0], [1]], [3, 0]), ([2, 0], [[0], [1]], [2, 5])])
def test_flow(capacity, members, quota):
    flows, _, cost = mixing.min_cost_flow(capacity, members, quota, 3)
    assert (sum(sum(f.values()) for f in flows), cost) == cheapest(capacity, members, quota, 3)
    assert all(set(f) <= set(m) for f, m in zip(flows, members))


@pytest.mark.parametrize(
    ("capacity", "members", "quota", "kinds", "kind_quota"),
    [([1, 2], [[0], [1]], [2, 1], [[0], [0]], [3]), ([1, 1, 1], [[0], [0], [1]], [2, 2], [[0], [1], [1]], [1, 3]), ([2, 1], [[0, 1], [1]], [1, 3], [[0], [1]], [2, 2]), ([1, 1], [[0], [1]], [3, 1], [[0], [0, 1]], [2, 2])],
)
def test_flow_through_two_layers(capacity, members, quota, kinds, kind_quota):
    into, onto, cost = mixing.min_cost_flow(capacity, members, quota, 3, kinds, kind_quota)
    assert (sum(sum(f.values()) for f in into), cost) == cheapest_of_two_layers(capacity, members, quota, kinds, kind_quota, 3)
    assert [sum(f.values()) for f in into] == [sum(f.values()) for f in onto]


def test_stretches_and_quotas():
    assert mixing.stretches({0: 3, 2: 4}, {1: 5, 3: 2}) == [(0, 3, 0, 1), (3, 5, 2, 1), (5, 7, 2, 3)] and mixing.stretches({1: 2}, None) == [(0, 2, 1, -1)] and mixing.stretches({}, {}) == []
    assert mixing.quotas({"a": 4, "b": 1}, None, 10) == {"a": 7, "b": 3} and mixing.quotas({}, None, 0) == {} and sum(mixing.quotas({"a": 1, "b": 1, "c": 1}, None, 10).values()) == 10


def docs(spark):
    rows = [(i, "x y" * (1 + i % 9), f"l{min(i % 7, 2)}", "hot" if i % 4 else f"s{i % 5}") for i in range(3000)]
    rows += [(4000, None, "l0", "hot"), (4001, "", "l0", "hot"), (None, "abcd", "l0", "hot"), (5, "abcd", None, None), (7, "abcd", "l1", "hot"), (7, "abcd", "l1", "hot"), (4002, "y z " * 25000, "l2", None)]
    return spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, lang string, source string, tokens int, uses string").repartition(5)


def counted(docs):
    enc = bpe.encoder(bpe.VOCABULARY)
    from weftline.llm.textarrays import text_buffers
    import pyarrow as pa

    rows = [r for r in docs.collect() if r["text"]]
    _, at = enc.encode(*text_buffers(pa.array([r["text"] for r in rows], pa.string())))
    return [(r, b - a) for r, a, b in zip(rows, at.tolist(), at[1:].tolist())]


def plainly_mixed(rows):
    """The uses, (doc_id, source, epoch), of [(doc_id, source, lang, tokens, hash)] without equal hashes, by plain loops."""
    names = [sorted({f"source:{r[1]}" for r in rows}), sorted({f"lang:{r[2]}" for r in rows})]
    per = [{x: sum(r[3] for r in rows if key(r) == x) for x in layer} for layer, key in zip(names, (lambda r: f"source:{r[1]}", lambda r: f"lang:{r[2]}"))]
    quota = [mixing.quotas(layer, None, sum(r[3] for r in rows)) for layer in per]
    keys = sorted({(f"source:{r[1]}", f"lang:{r[2]}") for r in rows})
    own = {k: sorted((r for r in rows if (f"source:{r[1]}", f"lang:{r[2]}") == k), key=lambda r: r[4]) for k in keys}
    flow, _, _ = mixing.min_cost_flow([sum(r[3] for r in own[k]) for k in keys], [[names[0].index(k[0])] for k in keys], [quota[0][x] for x in names[0]], 4, [[names[1].index(k[1])] for k in keys], [quota[1][x] for x in names[1]])
    uses = []
    for k, f in zip(keys, flow):
        at = 0
        for epoch in range(4):
            for r in own[k]:
                if at < sum(f.values()):
                    uses.append((r[0], k[0], epoch))
                at += r[3]
    return sorted(uses)


@needs_vocabulary
def test_against_plain_loops(spark):
    d = docs(spark).where("doc_id <> 7 and source is not null and lang is not null")
    h = d.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).collect()
    h = {r["doc_id"]: r["h"] for r in h}
    want = plainly_mixed([(r["doc_id"], r["source"], r["lang"], n, h[r["doc_id"]]) for r, n in counted(d)])
    assert sorted((r["doc_id"], r["source"], r["epoch"]) for r in mixing.mixed(spark, d).collect()) == want


@needs_vocabulary
def test_selection_meets_the_quotas(spark):
    d = docs(spark)
    got = mixing.mixed(spark, d).collect()
    base = counted(d)
    n_of = {(r["doc_id"], r["text"]): n for r, n in base}
    total = sum(n for _, n in base)
    pattern = lambda r: (f"source:{r['source'] or ''}", f"lang:{r['lang'] or ''}")
    most, per = {}, [{}, {}]
    for r, n in base:
        most[pattern(r)] = max(most.get(pattern(r), 0), n)
        for layer, x in zip(per, pattern(r)):
            layer[x] = layer.get(x, 0) + n
    capacity = {k: sum(n for r, n in base if pattern(r) == k) for k in most}
    keys = sorted(capacity)
    names = [sorted(layer) for layer in per]
    quota = [mixing.quotas(layer, None, total) for layer in per]
    into, onto, _ = mixing.min_cost_flow([capacity[k] for k in keys], [[names[0].index(k[0])] for k in keys], [quota[0][x] for x in names[0]], 4, [[names[1].index(k[1])] for k in keys], [quota[1][x] for x in names[1]])
    took = Counter()
    for r in got:
        took[r["source"], r["kind"]] += r["tokens"]
    for k, f in zip(keys, into):
        assert abs(took[k] - sum(f.values())) <= most[k]  # each pattern within a document of its flow
    for layer, x in ((0, "source:hot"), (0, "source:s0"), (1, "lang:l0"), (1, "lang:l1")):
        real, slack = sum(n for k, n in took.items() if k[layer] == x), sum(most[k] for k in keys if k[layer] == x)
        assert abs(real - min(quota[layer][x], 4 * per[layer][x])) <= slack + 4 * most["source:", "lang:l2"]
    uses = Counter(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert max(uses.values()) > 1 and any(r["doc_id"] not in uses for r, _ in base)  # repeats and omissions
    assert all(e < 4 for e in {r["epoch"] for r in got})
    # The documents of a pattern are taken in the order of their hash, epoch by epoch.
    h = {(r["doc_id"], r["text"]): r["h"] for r in d.where("length(text) > 0").select("doc_id", "text", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).collect()}
    for k in keys:
        own = sorted({(h[r["doc_id"], r["text"]], r["doc_id"]) for r, _ in base if pattern(r) == k}, key=lambda x: x[0])
        flow = sum(into[keys.index(k)].values())
        for epoch in range(4):
            at, want = epoch * capacity[k], set()
            for x, doc in own:
                n = sum(n for (i, t), n in n_of.items() if h[i, t] == x) * sum(1 for r, _ in base if h[r["doc_id"], r["text"]] == x)
                if at < flow:
                    want.add(doc)
                at += n
            assert {r["doc_id"] for r in got if (r["source"], r["kind"]) == k and r["epoch"] == epoch} == want


@needs_vocabulary
def test_documents_and_options(spark):
    d = docs(spark)
    ids = lambda df: sorted(map(repr, df.collect()))
    whole = mixing.mixed_documents(spark, d)
    assert whole.columns == d.columns and ids(whole) == ids(mixing.mixed_documents(spark, d.repartition(2)))
    assert sorted((r["doc_id"] or -1) for r in whole.collect()) == sorted((r["doc_id"] or -1) for r in mixing.mixed(spark, d).collect())
    assert mixing.mixed(spark, d.limit(0)).count() == 0 and mixing.mixed_documents(spark, d.limit(0)).count() == 0
    # Overlapping sources on one layer: a document may serve either of its two.
    even = d.where("length(text) < 1000")
    both = mixing.mixed(spark, even, {"a": 1.0, "b": 3.0}, budget=0.5, sources=F.expr("array('a', if(doc_id % 2 = 0, 'b', null))")).collect()
    n = sum(n for _, n in counted(even))
    assert abs(sum(r["tokens"] for r in both if r["source"] == "b") - 0.375 * n) < 0.01 * n and {r["kind"] for r in both} == {None}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "STEP_BITS", 3)
        assert ids(mixing.mixed(spark, d)) == ids(mixing.mixed(spark, d, seed=42))
        few = ids(mixing.mixed(spark, d))
    assert few == ids(mixing.mixed(spark, d)) != ids(mixing.mixed(spark, d, seed=1))


def test_query_names():
    found = queries.queries()
    assert sum(n.startswith("op") for n in found) == 10 and "pipeline" in found
