from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import dom, urls


def one(spark, *columns, **row):
    return tuple(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(*columns).first())


def each(spark, inputs, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, url string")
    return [r[1] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_normalized(spark):
    cases = {
        "HTTP://Ex.COM": "http://ex.com/",
        "http://ex.com/a//b///c": "http://ex.com/a/b/c",
        "http://ex.com/p?b=2&a=1#frag": "http://ex.com/p?a=1&b=2",
        "http://ex.com:8080/A": "http://ex.com:8080/A",
        "http://ex.com?x=1": "http://ex.com/?x=1",
        "mailto:a@b.c": "mailto:a@b.c",
        None: None,
    }
    assert each(spark, cases, urls.normalized(F.col("url"))) == list(cases.values())
    for raw, want in cases.items():
        assert raw is None or dom.normalized(raw) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB/?&=#.:-1", max_size=30))
def test_normalized_is_idempotent(tail):
    try:
        once = dom.normalized("http://h.org/" + tail)
    except ValueError:
        return
    assert dom.normalized(once) == once


def test_scope(spark):
    cases = [("http://ex.com/a", False, True), ("http://docs.ex.com/", False, False), ("http://docs.ex.com/", True, True), ("http://notex.com/", True, False), ("http://ex.com:81/", False, False)]
    for url, sub, want in cases:
        assert one(spark, urls.in_scope(F.col("url"), "EX.com", sub), url=url) == (want,)


def test_filenames(spark):
    names = each(spark, ["http://e.com/", "http://e.com/a b/c?q=1&r=2", "http://e.com/%%%", "http://e.com/" + "x" * 300], urls.page_filename(F.col("url")))
    assert names[0].startswith("index__") and names[1].startswith("a-b-c__q-1-r-2__") and names[2].startswith("page__")
    assert names[3].startswith("x" * 120 + "__") and all(n.endswith(".md") for n in names)
    images = each(spark, ["http://e.com/i/cat.png", "http://e.com/i/cat.toolong", "http://e.com", "http://e.com/a.tar.gz"], urls.image_filename(F.col("url")))
    assert images[0].startswith("cat-") and images[0].endswith(".png") and images[1].endswith(".img") and images[2].startswith("image-") and images[3].startswith("a.tar-")
    shots = each(spark, ["http://e.com/i/x.html/", "http://e.com/"], urls.screenshot_filename(F.col("url")))
    assert shots[0].startswith("x.html-") and shots[1].startswith("e.com-")


def test_locales(spark):
    cases = {"http://e.com/de/a": "de", "http://e.com/docs/fr": "fr", "http://e.com/en/98": None, "http://e.com/zz/a": None, "http://e.com/pt-BR/a": "pt-br", "http://e.com/": None, "http://e.com/a/b/de/": None, None: None}
    assert each(spark, cases, urls.locale_segment(F.col("url"))) == list(cases.values())
    assert each(spark, ["http://e.com/de/a", "http://e.com/en-nz/a", "http://e.com/x"], urls.foreign_locale(F.col("url"))) == [True, False, False]


def test_sections(spark):
    assert each(spark, ["http://e.com/", "http://e.com/a", "http://f.com/a/b"], urls.section(F.col("url"))) == ["/", "/a", "/a/*"]
    assert each(spark, ["http://e.com/", "http://e.com/a/b"], urls.first_segment(F.col("url"))) == ["/", "/a"]


def test_path_scope(spark):
    cases = {
        "https://e.com/": None,
        "https://e.com/docs": None,
        "https://e.com/docs/transform/": "/docs/transform/*",
        "https://e.com/wiki/Thing/x": None,
        "https://e.com/cat/x/y": None,
        "https://e.com/us/en/cat/sofas": "/us/en/*",
        "https://e.com/a/collections/x/products/y": "/a/collections/x/*",
        "https://e.com/stable/guide.html": None,
        "https://e.com/a/b/guide.html": "/a/b/*",
        "https://e.com/a/b/index": "/a/b/*",
    }
    assert each(spark, cases, urls.path_scope(F.col("url"))) == list(cases.values())


def test_priority(spark):
    seed = F.lit("https://e.com/a/b/c/d")
    assert each(spark, ["https://e.com/a/b/x", "https://e.com/a/b/c/d/e", "https://e.com/x/b", "https://e.com/"], urls.path_priority(F.col("url"), seed)) == [0.5, 1.0, 0.0, 0.0]
    assert each(spark, ["https://e.com/a"], urls.path_priority(F.col("url"), F.lit("https://e.com/"))) == [0.0]


def test_globs(spark):
    column = urls.path_excluded(F.col("url"), ("/docs/*",), ("*/old?",), ("http://e.com/",), i18n=True)
    cases = {"http://e.com/docs/a/b": False, "http://e.com/docs/old1": True, "http://e.com/blog": True, "http://e.com/": False, "http://e.com/de/docs": True}
    assert each(spark, cases, column) == list(cases.values())
    assert urls.glob_regex("[!a]x") == r"(?s)^[^a]x\z"


def test_citation_and_slug(spark):
    got = one(spark, urls.citation(F.lit(""), F.col("url"), F.to_timestamp(F.lit("2026-03-05 00:00:00"))), urls.slug(F.col("url")), urls.site_directory(F.col("url")), url="https://E.com:8/a/b")
    assert got == ("Untitled. E.com:8. Available at: https://E.com:8/a/b [Accessed March 05, 2026].", "E.com:8_a_b", "e.com")


def test_scores(spark):
    got = each(spark, ["http://e.com/a/b", "http://e.com/docs/b", "http://e.com/a.pdf", "http://e.com/" + "/".join("x" * 20)], urls.yield_score(F.col("url"), F.lit(100)))
    assert [round(x, 6) for x in got] == [90.0, 117.0, 10.0, 30.0]
