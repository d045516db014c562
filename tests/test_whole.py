"""Queries over pages that the test tables lack: none, several and nested articles."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.operators import pages, search

FOUND = entry.queries()


def prose(word, n=30):
    return " ".join(f"{word}{i}" for i in range(n))


def made(spark, tmp_path, bodies):
    rows = [(i, f"https://h.com/p{i}", body) for i, body in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


BODIES = [
    f"<title>None</title><nav>top</nav><main><p>{prose('main')}</p></main>",
    f"<div role=main><p>{prose('role')}</p></div>",
    f"<nav>top</nav><div><p>{prose('dense')}</p></div>",
    f"<title>A &eacute;</title><article><p>{prose('one')}</p></article><article><p>{prose('two')}</p></article><section><article>{prose('three')}</article></section>",
    f"<article><p>{prose('outer')}</p><article>{prose('inner', 5)}</article><p>{prose('after')}</p></article>",
    f"<article><p>{prose('nest')}</p></article><div class=content><p>{prose('lead')}</p><article>{prose('held')}</article></div>",
    f"<article>a &amp; b {prose('plain')}</article><div>short</div>",
]


def wanted(body):
    """Brute force: every generated word, and what else is text of the page's main part."""
    return " ".join(re.findall(r"\b(?:main|role|dense|one|two|three|outer|inner|after|nest|lead|held|plain)\d+\b", body))


def test_content_of_none_several_and_nested_articles(spark, tmp_path):
    sf = made(spark, tmp_path, BODIES)
    rows = {r["url"][-1]: r for r in FOUND["page_rows"](spark, sf).collect()}
    assert {k: r["text"].removeprefix("a &amp; b ") for k, r in rows.items()} == {str(i): wanted(b) for i, b in enumerate(BODIES)}
    assert rows["3"]["title"] == "A é" and rows["0"]["title"] == "None"
    assert FOUND["dedup_exact"](spark, sf).count() == len(BODIES)
    words = {r["page_id"]: (r["words"], r["kept"]) for r in FOUND["word_counts"](spark, sf).collect()}
    assert words[3] == (90, True) and words[4] == (65, True) and words[0] == (30, True)
    assert FOUND["page_list"](spark, sf).where("words = 0").count() == 0


def test_edges_of_all_kinds_of_href(spark, tmp_path):
    body = """<a href='/single'>a</a><a href=/bare>b</a><a href = "/spaced">c</a><a href="/e?b=2&amp;a=1">d</a><a href="b.html">e</a><a href="../x">f</a><a href="?p=2">g</a><a class=k HREF="//o.com/y">h</a>"""
    spark.createDataFrame([(1, "https://h.com/d/e/p", body), (2, "https://h.com/q", "<a href='/single'>a</a>"), (3, "https://h.com/n", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sf = str(tmp_path)
    want = {"https://h.com" + p for p in ("/single", "/bare", "/spaced", "/e?a=1&b=2", "/d/e/b.html", "/d/x", "/d/e/p?p=2")} | {"https://o.com/y"}
    assert {r["dst"] for r in FOUND["link_edges"](spark, sf).where("page_id = 1").collect()} == want
    assert {r["dst"]: r["n_pages"] for r in FOUND["link_indegree"](spark, sf).collect()} == {d: 1 + d.endswith("/single") for d in want}
    assert {r["url"] for r in FOUND["frontier_round"](spark, sf).collect()} == want - {"https://o.com/y"}
    assert FOUND["link_scores"](spark, sf).count() == len(want)


@pytest.mark.parametrize("block", [7, 8192])
def test_every_vector_is_a_query(spark, block):
    rng = random.Random(1)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)], rng.choice([0, 1, 2])) for i in range(40)] + [(40, [0.1, 0.2, 0.3], 9), (41, [0.0, 0.0, 0.0], 1), (42, rng.choices((1.0, 2.0), k=3), None)]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else -2.0

    want = {}
    for i, v, label in rows:
        order = sorted((-cosine(v, w), j, other) for j, w, other in rows if j != i)
        want[i] = next((k for k, (_, _, other) in enumerate(order, 1) if label is not None and other == label), None)
    df = spark.createDataFrame(rows, "id long, vector array<double>, label long")
    assert {r["query_id"]: r["rank"] for r in search.match_ranks(df, block).collect()} == want
    some = {r["query_id"]: r["rank"] for r in search.match_ranks(df, block, F.col("id") % 10 == 0).collect()}
    assert some == {i: r for i, r in want.items() if i % 10 == 0}


def test_keep_first_of_ties_and_nulls(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n"), (4, None, "n"), (None, "c", "only"), (2, "b", "first")]
    df = spark.createDataFrame(rows, "page_id long, content string, weft_note string")
    got = sorted(map(tuple, pages.keep_first(df).collect()), key=repr)
    assert got == sorted([(1, "a", "x"), (2, "b", "first"), (4, None, "n"), (4, None, "n"), (None, "c", "only")], key=repr) and pages.keep_first(df).columns == df.columns
    assert pages.keep_first(df.limit(0)).count() == 0
