import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import enrich, evaluate, pages, search
from weftline.streaming import pages as stream
from weftline.streaming import throttle

ROWS = [("http://e.com/A/", "Cats", "A page on cats and dogs"), ("http://e.com/b", None, "Dogs only, dogs"), ("http://e.com/c", "", None)]


def index(spark):
    return spark.createDataFrame(ROWS, "url string, title string, text string")


def test_keywords_lookup_listing(spark):
    got = search.keyword_search(index(spark), "DOGS cat cat", 5).collect()
    assert [(r["url"][-2:], r["score"]) for r in got] == [("A/", 3), ("/b", 1)]
    assert search.find_page(index(spark), "HTTP://e.com/a").first()["title"] == "Cats" and search.find_page(index(spark), "x").count() == 0
    assert [(r["title"], r["words"]) for r in search.listing(index(spark)).orderBy("url").collect()] == [("Cats", 6), ("Untitled", 3), ("", 0)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id int, embedding array<float>")
    got = search.nearest(df, [1.0, 0.0], 4).collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4] and got[2]["similarity"] is None


def test_containment_and_metrics(spark):
    spans = spark.createDataFrame([("f", "CAT"), ("f", "none"), ("g", "cat")], "k string, span string")
    chunks = spark.createDataFrame([("f", 3, "a cat"), ("f", 1, "Cats"), ("g", 7, "dog")], "k string, i int, chunk string")
    assert {tuple(r) for r in search.first_containing(spans, chunks, "span", "chunk", "i", ["k"]).collect()} == {("f", "CAT", 1), ("f", "none", None), ("g", "cat", None)}
    odd = spark.createDataFrame([(None, 1, "abc"), ("f", 2, None), (None, None, "xyz"), (None, 5, "xbcz"), ("f", 9, "BC")], "k string, i int, chunk string")
    asked = spark.createDataFrame([("f", "bc"), ("f", "bc"), (None, "BC"), (None, ""), (None, None), (None, "xyz"), ("f", "c")], "k string, span string")
    for most in (1 << 22, 1):
        assert {tuple(r) for r in search.first_containing(asked, odd, "span", "chunk", "i", ["k"], most).collect()} == {("f", "bc", 9), (None, "BC", 1), (None, "", 1), (None, None, None), (None, "xyz", None), ("f", "c", 9)}
        assert sorted((r["first_index"] or -1) for r in search.first_containing(asked.select("span"), odd, "span", "chunk", "i", most=most).collect()) == [-1, -1, 1, 1, 1, 1]
    plan = search.first_containing(asked, odd, "span", "chunk", "i")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert search.first_containing(asked.limit(0), odd, "span", "chunk", "i").count() == 0 and search.first_containing(asked, odd.limit(0), "span", "chunk", "i").where("first_index is not null").count() == 0
    m = search.rank_metrics(spark.createDataFrame([(1,), (3,), (None,)], "rank int")).first()
    assert (m["queries"], m["mrr"], m["hit_1"], m["hit_5"], m["misses"]) == (3, round((1 + 0.3333) / 3, 4), 1, 2, 1)


def test_bm25_gives_rows_with_a_word_of_the_query(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b b c"), (3, "c"), (4, None), (5, "")], "id int, text string")
    assert {r["id"] for r in search.bm25(spark, df, "B a b").collect()} == {1, 2} and search.bm25(spark, df, "").count() == 0


def test_hybrid(spark):
    df = spark.createDataFrame([(1, "a b", [1.0, 0.0]), (2, "b b c", [0.0, 1.0]), (3, "c", [1.0, 1.0])], "id int, text string, embedding array<float>")
    assert [r["id"] for r in search.hybrid(spark, df, "b", [1.0, 0.0], alpha=1.0).collect()] == [1, 3, 2]
    assert [r["id"] for r in search.hybrid(spark, df, "b", [1.0, 0.0], alpha=0.0).collect()][0] == 2
    assert all(r["score"] == 0 for r in search.hybrid(spark, df.where("id = 1"), "b", [1.0, 0.0]).collect())


def test_spread_sample(spark):
    df = spark.createDataFrame([(s, f"u{i}") for i, s in enumerate("aaaaab")], "_source string, url string")
    assert sorted(r["_source"] for r in search.spread_sample(df, 4).collect()) == ["a", "a", "a", "b"]
    assert search.spread_sample(df.where("_source = 'a'"), 3).count() == 3


def test_extraction_by_model(spark):
    def complete(prompt):
        if "=== page 1" in prompt:
            return '```json\n{"fields": ["name", "price"]}\n```'
        return '{"name": "N", "price": 3, "other": 1}' if "cats" in prompt else "sorry"

    got = {r["url"][-2:]: r["fields"] for r in enrich.extract_fields(index(spark), ["name", "price"], complete, "m").collect()}
    assert got["A/"] == {"name": "N", "price": "3"} and got["/b"] == {"name": None, "price": None}
    assert enrich.discover_fields(index(spark), complete) == ["name", "price"] and enrich.discover_fields(index(spark), lambda p: "?") == []
    assert enrich.extract_all(index(spark), complete, " name , ").first()["fields"].keys() == {"name"}
    assert enrich.extract_all(index(spark), complete).first()["fields"].keys() == {"name", "price"}


def test_vector_rows_and_insert(spark, tmp_path):
    df = spark.createDataFrame([("u", "T", "p.md", "# H\n\n" + "w " * 10), ("v", "", "p.txt", "x " * 500), ("w", None, None, None)], "url string, title string, path string, text string")
    rows = enrich.vector_rows(df, most=400)
    got = rows.orderBy("url", "chunk_index").collect()
    assert [(r["url"], r["chunk_index"], r["chunk_total"]) for r in got] == [("u", 0, 1), ("v", 0, 2), ("v", 1, 2)] and len(got[0]["embedding"]) == 256
    folder = str(tmp_path)

    def put(batch):
        import os
        import uuid

        if not os.path.exists(f"{folder}/failed"):
            open(f"{folder}/failed", "w").close()
            raise OSError("once")
        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump([r["url"] for r in batch], f)

    assert sum(r[0] for r in enrich.insert(rows.select("url").coalesce(1), put, 2, pause=0.0).collect()) == 3
    assert sorted(u for p in tmp_path.glob("*.json") for u in json.loads(p.read_text())) == ["u", "v", "v"]


def test_extractors(spark):
    df = spark.createDataFrame([("<title>t</title><main>body text</main>",), (None,)], "html string")
    pages.register_extractor("shout", lambda html, url: {"title": "X", "content": html.upper()})
    pages.register_extractor("broken", lambda html, url: 1 / 0)
    one = lambda backend: df.select(pages.extract(F.col("html"), backend=backend).alias("x")).collect()
    assert one("shout")[0]["x"]["content"].startswith("<TITLE>") and one("broken")[0]["x"]["content"] == "body text"
    assert one("default")[1]["x"]["content"] is None
    both = spark.createDataFrame([("a b c", "a b c d e"), ("a", "b"), ("x", None)], "a string, b string")
    assert [r["content"] for r in pages.best_of(both, ["a", "b"]).collect()] == ["a b c d e", "a", "x"]


def test_evaluation(spark):
    html = "<title>Doc</title><main>" + "".join(f"<h2>Part {i}</h2><p>{' '.join(f'word{i}x{j}' for j in range(90))}</p>" for i in range(6)) + "</main>"
    cases = spark.createDataFrame([("f", html, "word3x1 word3x2 word3x3 part 3", "word3x5"), ("f", html, "q", "absent")], "fixture string, html string, query string, answer_span string")
    got = {r["answer_span"]: r["rank"] for r in evaluate.ranks(cases).collect()}
    assert got == {"word3x5": 1, "absent": None}
    df = spark.createDataFrame([("# a\n\nb [x](y)",), ("plain",)], "content string")
    s = evaluate.summary(evaluate.diagnostics(df)).first()
    assert (s["pages"], s["total_n_words"], s["total_n_headings"], s["with_paragraphs"], s["total_nav_words"]) == (2, 5, 1, 1, 1)
    both = evaluate.compare(df, {"one": F.col("content"), "two": F.lit("x")})
    assert {r["metric"]: (r["one"], r["two"]) for r in both.collect()}["total_n_words"] == (5.0, 2.0)


@pytest.mark.parametrize(("change", "want"), [({}, "NEUTRAL"), ({"mrr": 0.6}, "ACCEPTED"), ({"mrr": 0.4}, "REJECTED"), ({"mrr": 0.9, "misses": 2}, "REJECTED"), ({"nav_words": 3}, "REJECTED"), ({"chunks": 16}, "REJECTED"), ({"mrr": 0.504}, "NEUTRAL")])
def test_guards(spark, change, want):
    base = {"fixture": "f", "mrr": 0.5, "misses": 1, "nav_words": 1, "total_ms": 10, "chunks": 10}
    make = lambda d: spark.createDataFrame([tuple(d.values())], "fixture string, mrr double, misses long, nav_words long, total_ms long, chunks long")
    assert evaluate.guards(make(base), make(base | change)).first()["verdict"] == want


ANSWERS = [(1, i, s, t) for i, (s, t) in enumerate([(200, 0.1), (429, None), (429, 0.0), (200, 0.1), (200, 0.1), (200, 9.0), (None, None), (200, 0.2)])] + [(2, 0, 200, 2.0)]


def test_throttle_steps(spark):
    df = spark.createDataFrame(ANSWERS, "host long, n long, status int, seconds double")
    got = [tuple(r) for r in throttle.delays(df, "host", "n", base=0.5).orderBy("host", "n").collect()]
    delays = [round(d, 4) for h, _, d in got if h == 1]
    assert delays[:5] == [0.5, 1.0, 2.0, 2.0, 0.5] and delays[5] == round((0.1 * 3 + 9) / 4 / 2, 4) and delays[6] == delays[5] and got[-1] == (2, 0, 1.0)


def test_throttle_stream_equals_batch(spark, tmp_path):
    schema = "host long, n long, status int, seconds double"
    for k in range(3):
        spark.createDataFrame([a for a in ANSWERS if a[1] // 3 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.write_stream(throttle.delay_stream(raw, "host", "n", base=0.5), str(tmp_path / "out"), str(tmp_path / "cp"), "parquet").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, throttle.delays(spark.createDataFrame(ANSWERS, schema), "host", "n", base=0.5).collect()))


def test_page_stream_dedups_across_runs(spark, tmp_path):
    body = lambda w: f"<title>t</title><main>{' '.join(w + str(i) for i in range(25))}</main>"
    put = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for rows in ([(1, "http://e.com/1", body("a")), (2, "http://e.com/2", body("b"))], [(3, "http://e.com/3", body("a")), (4, "http://e.com/4", body("c")), (5, "http://e.com/5", "thin")]):
        put(rows)
        q = stream.write_stream(stream.clean_stream(stream.page_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert {r["url"][-1] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"1", "2", "4"}


def test_pairs_are_exact_where_single_precision_is_not():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    close = base[rng.integers(0, 40, 260)] + rng.normal(size=(260, 16)) * 10.0 ** rng.integers(-8, 0, 260)[:, None]
    vectors = np.concatenate([base, close, base[:5], np.zeros((2, 16))])  # many similarities part in the sixth place only
    ids = [f"v{i:03d}" for i in rng.permutation(len(vectors))]
    t = pa.table({"id": ids, "vector": [None if not v.any() and k % 2 else list(v) for k, v in enumerate(vectors)]})
    own, place = search.Pairs(t, t), {i: k for k, i in enumerate(ids)}
    size = np.sqrt((vectors * vectors).sum(axis=1))
    want = [[round(float(a @ b) / (x * y), 6) if x * y else -2.0 for b, y in zip(vectors, size)] for a, x in zip(vectors, size)]
    r, s, j = own.best()
    assert list(r) == list(range(len(ids)))
    match = [own.c_ids[int(k)].as_py() for k in j]
    for k, (similarity, found) in enumerate(zip(s, match)):
        assert (-similarity, found) == min((-want[k][m], i) for m, i in enumerate(ids) if m != k)
    far = [ids[(k * 7 + 1) % len(ids)] for k in range(len(ids))]  # any other vector as the match
    mine = np.array([want[k][place[i]] for k, i in enumerate(far)])
    ahead = own.ahead(mine, np.array(far, dtype=object), 64, 50)
    assert list(ahead) == [sum((-want[k][m], i) < (-mine[k], far[k]) for m, i in enumerate(ids) if m != k) for k in range(len(ids))]
