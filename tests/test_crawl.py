import time
import uuid

import pytest

from weftline.errors import ConfigurationError
from weftline.operators import crawl as c
from weftline.operators import frontier
from weftline.sources.fetch import Response


def body(name, links):
    return f"<html><head><title>{name}</title></head><body><nav>{''.join(f'<a href={u}>{u}</a>' for u in links)}</nav><main><p>{' '.join(f'{name}{i}' for i in range(30))}</p></main>"


SITE = {
    "/": body("home", ["/a", "/b", "/thin", "/private", "http://other.com/"]),
    "/a": body("apple", ["/b", "/c", "/"]),
    "/b": body("home", ["/never"]),  # same words as the home page: a duplicate
    "/c": body("cherry", ["/a#x", "/d.html"]),
    "/d.html": body("date", []),
    "/thin": "<p>thin</p><a href=/never2>x</a>",
    "/robots.txt": "User-agent: *\nDisallow: /private\n",
}


def client(url):
    path = url.partition("//")[2].partition("/")[2]
    page = SITE.get(f"/{path}")
    if page is None:
        return Response(404, b"", {"content-type": "text/html"})
    return Response(200, page.encode(), {"content-type": "text/plain" if "robots" in path else "text/html"})


def urls_of(result):
    return {r["url"].removeprefix("http://e.com") for r in result.rows.collect()}


def test_crawl_saves_what_is_reachable_new_and_allowed(spark, tmp_path):
    got = c.crawl(spark, "http://e.com", str(tmp_path / "o"), client)
    assert urls_of(got) == {"/", "/a", "/c", "/d.html"} and got.pages_saved == 4 and got.frontier.isEmpty()
    row = next(r for r in got.rows.collect() if r["url"] == "http://e.com/a")
    assert row["title"] == "apple" and row["text"].startswith("apple0 apple1") and row["path"].startswith("a__")
    assert not (tmp_path / "o/state").exists()


def test_budget_then_resume(spark, tmp_path):
    at = str(tmp_path / "o")
    first = c.crawl(spark, "http://e.com", at, client, c.Options(max_pages=2, batch=1))
    assert first.pages_saved == 2 and (tmp_path / "o/state").exists()
    rest = c.crawl(spark, "http://e.com", at, client, c.Options(resume=True))
    assert rest.pages_saved == 4 and urls_of(rest) == {"/", "/a", "/c", "/d.html"}


def test_auto_resume_interrupt_and_progress(spark, tmp_path):
    at, said = str(tmp_path / "o"), []

    def stop(message):
        said.append(message)
        if message.startswith("round 2"):
            raise KeyboardInterrupt

    first = c.crawl(spark, "http://e.com", at, client, c.Options(batch=1, auto_resume=True), progress=stop)
    assert first.rounds == 2 and said[-1].startswith("interrupted") and not first.frontier.isEmpty()
    rest = c.crawl(spark, "http://e.com", at, client, c.Options(auto_resume=True))
    assert rest.pages_saved == 4 and urls_of(rest) == {"/", "/a", "/c", "/d.html"} and rest.frontier.isEmpty()


def test_one_request_a_delay_and_host(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def recording(url):
        began = time.time()
        (log / uuid.uuid4().hex).write_text(f"{began} {url}")
        path = "/" + url.partition("//")[2].partition("/")[2]
        if path == "/":
            return Response(200, body("home", [f"/p{i}" for i in range(6)]).encode(), {"content-type": "text/html"})
        if path == "/robots.txt":
            return Response(200, b"User-agent: *\nCrawl-delay: 0.3\n", {"content-type": "text/plain"})
        n = len(list(log.iterdir()))
        return Response(429 if path == "/p0" and n < 4 else 200, body(f"w{path[1:]}", []).encode(), {"content-type": "text/html"})

    got = c.crawl(spark, "http://e.com", str(tmp_path / "o"), recording, c.Options(threads=8))
    assert got.pages_saved == 7
    starts = sorted(float(f.read_text().split()[0]) for f in log.iterdir() if not f.read_text().endswith("robots.txt"))
    gaps = [b - a for a, b in zip(starts, starts[1:])]
    assert min(gaps) > 0.28 and max(gaps) > 0.9  # a second at least after the 429
    assert all(r["crawled_at"] >= "2020" for r in got.rows.collect())


def test_overlays_are_cut_from_rendered_pages(spark, tmp_path):
    shell = '<html><body><div id="root"></div><script src="/x.js"></script>' + "<script>" + "x" * 2000 + "</script></body></html>"
    words = " ".join(f"w{i}" for i in range(30))
    plain = lambda url: Response(200, shell.encode(), {"content-type": "text/html"}) if url.rstrip("/").endswith("e.com") else Response(404)
    seen = lambda url: Response(200, f'<main><p>{words}</p><div class="modal" role="dialog">Subscribe now</div></main>'.encode(), {"content-type": "text/html"})
    got = c.crawl(spark, "http://e.com", str(tmp_path / "o"), plain, c.Options(use_sitemap=False), browser=seen).rows.first()
    assert got["text"] == words
    shot = c.crawl(spark, "http://e.com", str(tmp_path / "p"), lambda url: Response(404), c.Options(use_sitemap=False), browser=seen, render=lambda url, shot: b"png").rows.first()
    assert shot["text"] == words and shot["screenshot"]


def test_dry_run_and_filters(spark, tmp_path):
    dry = c.crawl(spark, "http://e.com", str(tmp_path / "d"), client, c.Options(dry_run=True))
    assert dry.pages_saved == 0 and [r["url"] for r in dry.frontier.collect()] == ["http://e.com/"]
    some = c.crawl(spark, "http://e.com", str(tmp_path / "f"), client, c.Options(exclude_paths=("/c*",), title_at_top=True))
    assert urls_of(some) == {"/", "/a"} and all(r["text"].startswith(f"# {r['title']}") for r in some.rows.collect())


def test_images_files_and_screenshots(spark, tmp_path):
    html = f"<main><p>{' '.join(f'w{i}' for i in range(30))}</p><img src=/i/big.png alt=Big><img src=/i/small.png alt=Small></main>"

    def illustrated(url):
        if url.endswith(".png"):
            return Response(200, b"i" * (9000 if "big" in url else 9), {"content-type": "image/png"})
        return Response(200, html.encode(), {"content-type": "text/html"}) if url == "http://e.com/" else Response(404)

    got = c.crawl(spark, "http://e.com", str(tmp_path), illustrated, c.Options(keep_images=True, page_files=True, smart_sample=True), render=lambda url, shot: b"png")
    row = got.rows.first()
    assert len(row["images"]) == 1 and (tmp_path / "assets" / row["images"][0]).stat().st_size == 9000
    assert f"![Big](assets/{row['images'][0]})" in row["text"] and "![Small](http://e.com/i/small.png)" in row["text"]
    assert (tmp_path / "screenshots" / row["screenshot"]).exists() and row["pattern"] == "/" and row["is_sample"] is False
    assert "> URL: http://e.com/" in (tmp_path / "files" / row["path"]).read_text()


def test_invalid_options(spark, tmp_path):
    for base, o in (("ftp://x", c.Options()), ("http://x", c.Options(min_words=-1)), ("http://x", c.Options(batch=0)), ("http://x", c.Options(form="pdf"))):
        with pytest.raises(ConfigurationError):
            c.crawl(spark, base, str(tmp_path), client, o)


def test_sites_fail_apart(spark, tmp_path):
    got = c.crawl_sites(spark, ["http://e.com/", "nonsense"], str(tmp_path), client, c.Options(max_pages=1))
    assert got["http://e.com/"].pages_saved == 1 and isinstance(got["nonsense"], ConfigurationError)


def test_placing(spark):
    df = spark.createDataFrame([("http://e.com/a/b/x", 1.0), ("http://e.com/z", 5.0)], "url string, score double")
    bands = lambda d: {r["url"][-1]: r["band"] for r in d.collect()}
    assert bands(frontier.placed(df, seed="http://e.com/a/b/c")) == {"x": 0, "z": 2} and bands(frontier.placed(df)) == {"x": 2, "z": 2}
    assert [r["url"][-1] for r in frontier.batch(frontier.placed(df, score="score"), 5).collect()] == ["z", "x"]
    assert frontier.batch(frontier.placed(df), 5, saved=3, most=4).count() == 1 and frontier.batch(frontier.placed(df), 5, 4, 4).count() == 0


def test_sampling_and_reach(spark):
    df = spark.createDataFrame([(f"http://e.com/p/{i}",) for i in range(30)] + [("http://e.com/q/1",)], "url string")
    got = frontier.smart_sample(df).collect()
    assert sum(r["pattern"] == "/p/*" for r in got) == 5 and [r["is_sample"] for r in got if r["pattern"] == "/q/*"] == [False]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in frontier.reached(spark, start, edges).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert frontier.reached(spark, start.limit(0), edges).count() == 0
