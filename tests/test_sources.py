import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.sources import fetch, files, robots


def test_pages_and_seeds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u1", "text": "é"}\n\n{"url": "u2", "title": "t"}\n')
    (tmp_path / "b.jsonl").write_text('{"url": "u3"}\n')
    one = files.read_pages(spark, str(tmp_path / "a.jsonl"))
    assert one.count() == 2 and "_source" not in one.columns
    both = files.read_pages(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert {(r["url"], r["_source"]) for r in both.collect()} == {("u1", "a.jsonl"), ("u2", "a.jsonl"), ("u3", "b.jsonl")}
    files.write_pages(one, str(tmp_path / "out"))
    files.write_pages(one.where("url = 'u1'"), str(tmp_path / "out"), resume=True)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"url": "u1", "text": "é"}] * 2 + [{"url": "u2", "title": "t"}]))
    (tmp_path / "seeds").write_text("# c\n\n http://a \nhttp://b\n")
    assert [r[0] for r in files.read_seeds(spark, str(tmp_path / "seeds")).collect()] == ["http://a", "http://b"]
    assert "examples" in files.seed_packs() and len(files.seed_pack("examples")) == 2
    with pytest.raises(ValueError):
        files.seed_pack("none")


def test_hashes_and_state(spark, tmp_path):
    at = str(tmp_path / "h")
    assert files.read_hashes(spark, at).count() == 0
    for hashes in (["a", "b", "a"], ["b", "c"]):
        files.append_hashes(spark, spark.createDataFrame([(h,) for h in hashes], "hash string"), at)
    assert sorted(r[0] for r in files.read_hashes(spark, at).collect()) == ["a", "b", "c"]
    state = str(tmp_path / "s")
    assert files.load_state(spark, state) is None
    for n in (1, 2):
        files.save_state(state, {t: spark.createDataFrame([(t * n,)], "url string") for t in files.STATE}, n, ["s"])
    got = files.load_state(spark, state)
    assert got["saved_count"] == 2 and got["to_visit"].first()[0] == "to_visit" * 2 and len(list((tmp_path / "s").glob("[!.]*"))) == 5
    for r in (1, 2):
        files.save_state(state, {t: spark.createDataFrame([(f"{t}{r}",)], "url string") for t in files.STATE}, 10 + r, ["s"], r)
    got = files.load_state(spark, state)
    assert (got["round"], got["saved_count"]) == (2, 12) and {r[0] for r in got["seen_urls"].collect()} == {"seen_urls" * 2, "seen_urls1", "seen_urls2"}
    spark.createDataFrame([("torn",)], "url string").write.parquet(f"{state}/seen_urls/round=3")  # a round without a note isn't done
    assert files.load_state(spark, state)["seen_urls"].count() == 3
    files.drop_state(spark, state)
    assert files.load_state(spark, state) is None


def test_one_hosts_requests_begin_a_delay_apart():
    """Eight threads, a slow clock of our own: the starts are as far apart as the delay asks for."""
    from concurrent.futures import ThreadPoolExecutor

    from weftline.streaming.throttle import Pace

    waits = []
    pace = Pace(2.0, clock=lambda: 100.0, sleep=waits.append)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: pace.turn(), range(6)))
    assert sorted(waits) == [2.0, 4.0, 6.0, 8.0, 10.0]
    pace.answered(429, None)
    pace.turn()
    assert waits[-1] == 14.0 and pace.state[:2] == (4.0, 1)  # the delay has doubled
    pace.turn()
    assert waits[-1] == 18.0


def test_cases_and_log(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    (tmp_path / "b.html").write_text("<p>y")
    (tmp_path / "a.queries.json").write_text('[{"query": "q", "answer_span": "x"}]')
    assert [tuple(r) for r in files.read_cases(spark, str(tmp_path)).collect()] == [("a", "<p>x", "q", "x")]
    for n in (1, 2):
        files.append_log(spark, [{"n": n}], str(tmp_path / "log"))
    assert sorted(r[0] for r in files.read_log(spark, str(tmp_path / "log"), "n int").collect()) == [1, 2]


def test_files_and_charsets(spark, tmp_path):
    files.write_files(spark.createDataFrame([("a.md", "x"), ("b.md", "é")], "path string, rendered string"), str(tmp_path / "f"))
    assert (tmp_path / "f/b.md").read_text() == "é" and len(list((tmp_path / "f").iterdir())) == 2
    df = spark.createDataFrame([(bytearray("é".encode()), "ISO-8859-1"), (bytearray(b"\xe9"), "iso-8859-1")], "b binary, c string")
    assert [r[0] for r in df.select(files.decoded(F.col("b"), F.col("c"))).collect()] == ["é", "é"]


ROBOTS = "User-agent: *\nDisallow: /private\nCrawl-delay: 2\n\nUser-agent: me\nCrawl-delay: 5\nSitemap: http://e.com/s.xml\nCrawl-delay: 9\n"


def test_robots(spark):
    assert not robots.may_fetch(ROBOTS, "x", "http://e.com/private/a") and robots.may_fetch("", "x", "http://e.com/private")
    assert robots.crawl_delay(ROBOTS, "me") == 5 and robots.crawl_delay("Crawl-delay: x\nCrawl-delay: 3", "me") == 3 and robots.crawl_delay("", "me") is None
    assert robots.crawl_delay("User-agent: a\nDisallow: /\nCrawl-delay: 4", "a") == 4
    assert robots.crawl_delay("User-agent: a\nDisallow: /\nCrawl-delay: 4", "b") == 4
    assert robots.crawl_delay("User-agent: a\nDisallow: /\nCrawl-delay: 4", "b", standard=True) is None
    df = spark.createDataFrame([("http://e.com/private/a", ROBOTS), ("http://e.com/a", ROBOTS), ("http://e.com/private", None)], "u string, r string")
    got = df.select(robots.allowed(F.col("u"), F.col("r")), robots.crawl_delays(F.col("r"), "me"), robots.sitemaps(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(False, 5.0, ["http://e.com/s.xml"]), (True, 5.0, ["http://e.com/s.xml"]), (True, None, None)]


def test_sitemaps():
    ns = f'xmlns="{robots.SITEMAP_NS[1:-1]}"'
    web = {
        "i": f"<sitemapindex {ns}><sitemap><loc>a</loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>bad</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>",
        "a": f"<urlset {ns}><url><loc> u1 </loc></url><url><loc>u2</loc></url></urlset>",
        "b": "<urlset><url><loc>u2</loc></url><url><loc>u3</loc></url></urlset>",
        "bad": "<html>no",
    }
    assert robots.sitemap_urls(["i"], web.get) == ["u1", "u2", "u3"]
    deep = {str(k): f"<sitemapindex {ns}><sitemap><loc>{k + 1}</loc></sitemap></sitemapindex>" for k in range(5)} | {"5": f"<urlset {ns}><url><loc>u</loc></url></urlset>"}
    assert robots.sitemap_urls(["0"], deep.get) == ["u"] and robots.sitemap_urls(["0"], deep.get, 4) == []


def test_retries():
    calls, waits = [], []

    def client(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError
        return fetch.Response(503 if len(calls) < 4 else 200)

    assert fetch.with_retries(client, sleep=waits.append)("u").status == 200 and waits == [0.5, 1.0, 2.0]
    assert fetch.with_retries(lambda u: fetch.Response(404), sleep=waits.append)("u").status == 404 and len(waits) == 3

    def down(url):
        raise OSError

    assert fetch.with_retries(down, sleep=lambda s: None)("u") is None


def test_fetched_images_and_screenshots(spark, tmp_path):
    def client(url):
        if "down" in url:
            raise OSError
        if url.endswith(".png"):
            return fetch.Response(200, b"i" * (6000 if "big" in url else 10), {"Content-Type": "image/png"})
        return fetch.Response(200, "<p>é".encode(), {"content-type": "text/html; charset=iso-8859-1"}, 12.5)

    df = spark.createDataFrame([("http://e.com/",), ("http://down/",)], "url string")
    got = {r["url"]: r for r in fetch.fetched(df, client, retries=0).collect()}
    assert got["http://e.com/"]["html"] == "<p>é" and got["http://e.com/"]["elapsed_ms"] == 12.5 and not got["http://down/"]["ok"]
    md = spark.createDataFrame([("![a](http://e.com/big.png) ![b](http://e.com/small.png) ![c](http://e.com/x) ![a](http://e.com/big.png)",)], "content string")
    stored = fetch.stored_images(md, client, str(tmp_path / "i")).collect()
    assert [r["url"] for r in stored] == ["http://e.com/big.png"] and (tmp_path / "i" / stored[0]["file"]).stat().st_size == 6000

    def render(url, shot):
        if "down" in url:
            raise RuntimeError("no")
        return b"png"

    shots = {r["url"]: r for r in fetch.screenshots(df, render, str(tmp_path / "s")).collect()}
    assert shots["http://down/"]["screenshot_error"] == "RuntimeError: no" and (tmp_path / "s" / shots["http://e.com/"]["screenshot"]).read_bytes() == b"png"
    assert fetch.needs_browser(client, "http://e.com/", lambda h: "é" in h) and not fetch.needs_browser(client, "http://down/", lambda h: True)


def test_batches_of_texts_are_small(spark):
    from pyspark.sql import functions as F

    from weftline.functions import chunking
    from weftline.operators import enrich, pages

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([("a", "u")], "text string, url string")
    html, url = F.col("text"), F.col("url")
    steps = [lambda: pages.extract(html, url), lambda: pages.main_text(html, url), lambda: pages.links(html, url), lambda: pages.page_signals(html, url), lambda: pages.without_overlays(html), lambda: chunking.chunks(html), lambda: enrich.embedded(html), lambda: enrich.extract_fields(df, ["a"], str), lambda: enrich.insert(df, len)]
    was = spark.conf.get(key)
    try:
        for k, step in enumerate(steps):
            spark.conf.set(key, "10000")
            step()
            assert spark.conf.get(key) == "1000", k
        spark.conf.set(key, "77")
        steps[0]()
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, was)


def test_links_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from weftline.operators import pages

    df = spark.range(2).selectExpr("concat('<a href=\"/', id, '\">x</a>') as html", "'http://e.com/' as url")
    found = df.select(pages.links(F.col("html"), F.col("url")).alias("links")).select(F.explode("links").alias("dst")).where("dst <> ''")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r[0] for r in found.collect()) == ["http://e.com/0", "http://e.com/1"]


def test_stored_pages_are_written_by_many_tasks(spark, tmp_path):
    from weftline.plans import stores

    own = spark.range(400).selectExpr("id as page_id", "concat('http://e.com/', id) as url", "concat('<title>', id, '</title>', repeat('word ', 50)) as html")
    own.repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "4096")
        rows = stores.stored_pages(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows.inputFiles()) > 2 and rows.count() == 400
    assert {(r["folder"], int(r["title"]) % 2) for r in rows.collect()} == {("even", 0), ("odd", 1)}


def test_kept_tables(spark, tmp_path):
    from types import SimpleNamespace as Named

    from weftline.errors import ConfigurationError
    from weftline.sources import tables

    unset = Named(get=lambda key, default=None: default, set=lambda key, value: None)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ConfigurationError):
            tables.shared_dir(Named(conf=unset, sparkContext=Named(master=master)))
    assert tables.shared_dir(Named(conf=unset, sparkContext=Named(master="local[4]"))).startswith("file://")
    one = tables.kept(spark, spark.range(3).toDF("x"), "one")
    other = tables.kept(spark, one.where("x > 0"), "other")
    tables.dropped(spark, one)
    assert sorted(r[0] for r in other.collect()) == [1, 2] and not os.path.exists(one.weft_path.removeprefix("file://")) and os.path.exists(other.weft_path.removeprefix("file://"))
