"""The crawl: rounds of fetch, extract, deduplicate, save and follow links.

Each round is a Spark job over a batch of the frontier; its outcome is written to the
shared folder before the next begins, so no lineage grows and executors may be lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError
from weftline.functions import text, urls
from weftline.operators import frontier, pages
from weftline.sources import files, robots
from weftline.sources.fetch import Client, Shot, fetched, needs_browser, paces_of, screenshots, stored_images
from weftline.sources.tables import dropped, kept

URLS = "url string"
LINKS = "url string, band int, place double"


@dataclass
class Options:
    max_pages: int = 500  # 0: no limit
    batch: int = 64
    min_words: int = 20
    delay: float = 0.0
    threads: int = 4
    agent: str = "weftline"
    form: str = "markdown"
    backend: str = "default"
    include_subdomains: bool = False
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    i18n_filter: bool = False
    auto_path_scope: bool = True
    auto_path_priority: bool = True
    prioritize_links: bool = False
    smart_sample: bool = False
    sample_size: int = 5
    sample_threshold: int = 20
    title_at_top: bool = False
    keep_images: bool = False  # fetch images to out/assets and refer to them there
    min_image_bytes: int = 5000
    page_files: bool = False  # a file for each page in out/files, a folder that all executors share
    use_sitemap: bool = True
    dry_run: bool = False
    resume: bool = False  # go on from the state in out/state, an error if there is none
    auto_resume: bool = False  # go on from it if there is one, else begin anew
    cross_run_hashes: str | None = None
    crawled_at: str | None = None  # yyyy-MM-dd HH:mm:ss; by default when the crawl began, in UTC

    def checked(self, base: str) -> "Options":
        if not base.lower().startswith(("http://", "https://")):
            raise ConfigurationError("the base address must begin with http:// or https://")
        for name in ("max_pages", "min_words", "delay", "sample_threshold"):
            if getattr(self, name) < 0:
                raise ConfigurationError(f"{name} can't be negative")
        for name in ("batch", "threads", "sample_size"):
            if getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must be positive")
        if self.form not in ("markdown", "text"):
            raise ConfigurationError("form is markdown or text")
        return self


@dataclass
class Result:
    pages_saved: int
    rows: DataFrame  # the page index
    frontier: DataFrame  # what is left to visit
    out: str
    rounds: int = 0


def robots_of(client: Client, base: str) -> str:
    """robots.txt of the site; what can't be had allows everything."""
    import urllib.parse

    try:
        r = client(urllib.parse.urljoin(base, "/robots.txt"))
    except (OSError, ValueError):
        return ""
    return r.text if r.ok else ""


def _text_of(client: Client):
    def get(url: str) -> str | None:
        try:
            r = client(url)
        except (OSError, ValueError):
            return None
        return r.text if r.ok else None

    return get


def with_local_images(good: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages with images, the sorted names of their stored images, to which the text refers."""
    refs = good.select("url", F.explode(text.image_references(F.col("content"))).alias("r")).select("url", F.col("r.url").alias("image")).distinct()
    own = refs.join(stored.select(F.col("url").alias("image"), "file"), "image")
    maps = own.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("image", "file"))).alias("weft_files"), F.sort_array(F.collect_list("file")).alias("images"))
    return good.join(maps, "url", "left").withColumn("content", text.rewrite_images(F.col("content"), F.col("weft_files"))).drop("weft_files")


def crawl(spark: SparkSession, base: str, out: str, client: Client, options: Options | None = None, browser: Client | None = None, render: Callable[[str, Shot], bytes] | None = None, progress: Callable[[str], None] | None = None) -> Result:
    """Crawls a site into out/pages (JSON lines). robots.txt is honoured; seeds come from the
    sitemaps it names, else the base address. Links are followed only from saved pages, in
    the order (band, place, url).

    With a browser client, sites that look like client-side apps, and all sites of which
    pictures are taken, are fetched by it, and dialogs and banners are cut from its pages.
    With a renderer saved pages have a screenshot. progress is told of each round.

    Each round adds to the state folder, which goes when the frontier is empty. After an
    interrupt (Ctrl-C) the rounds done so far are returned, and a later run resumes from
    them; the round that was broken off is done again."""
    o = (options or Options()).checked(base)
    tell = progress or (lambda message: None)
    rules = robots_of(client, base)
    rendered = browser is not None and (render is not None or needs_browser(client, base, lambda html: spark.range(1).select(text.is_spa(F.lit(html))).first()[0]))
    client = browser if rendered else client
    host = spark.range(1).select(urls.normalized(F.lit(base)).alias("u")).select("u", urls.netloc(F.col("u")), urls.path_scope(F.lit(base))).first()
    start, netloc, scope = host
    include = o.include_paths or ((scope,) if o.auto_path_scope and scope else ())
    delay = max(o.delay, robots.crawl_delay(rules, o.agent) or 0.0)
    mine = F.lit(rules)

    def wanted(df: DataFrame) -> DataFrame:
        df = df.where(urls.in_scope(F.col("url"), netloc, o.include_subdomains))
        df = df.where(~urls.path_excluded(F.col("url"), include, o.exclude_paths, (start,), o.i18n_filter))
        return df.where(robots.allowed(F.col("url"), mine, o.agent)) if rules else df

    place = lambda df, score=None: frontier.placed(df, seed=start if o.auto_path_priority else None, score=score).select("url", "band", F.col("place").cast("double").alias("place"))
    state_at, rows_at = f"{out}/state", f"{out}/pages"
    old = files.load_state(spark, state_at) if o.resume or o.auto_resume else None
    clusters = None
    state = lambda n: {name: files.state_table(spark, state_at, name, n) for name in files.STATE}
    if old:
        saved, round_ = old["saved_count"], old["round"]
        tell(f"resumed after {saved} pages")
    else:
        maps = [r[0] for r in spark.range(1).select(F.explode(robots.sitemaps(mine))).collect()] if o.use_sitemap else []
        found = robots.sitemap_urls(maps, _text_of(client)) if maps else []
        seeds = wanted(spark.createDataFrame([(u,) for u in found], URLS).select(urls.normalized(F.col("url")).alias("url")).distinct()) if found else None
        if seeds is None or seeds.isEmpty():
            seeds = spark.createDataFrame([(start,)], URLS)
        if o.smart_sample:
            clusters = kept(spark, frontier.smart_sample(seeds, threshold=o.sample_threshold, sample=o.sample_size), "clusters")
            seeds = clusters.select("url")
        saved, round_ = 0, 0
        if o.dry_run:
            return Result(0, spark.createDataFrame([], files.PAGE), place(seeds), out)
        none = {"seen_urls": URLS, "seen_content": "hash string", "visited_for_links": URLS}
        files.save_state(state_at, {n: spark.createDataFrame([], s) for n, s in none.items()} | {"to_visit": place(seeds)}, 0, [start])
    left = lambda sets: frontier.candidates(sets["to_visit"], sets["seen_urls"])
    if o.dry_run:
        return Result(0, spark.createDataFrame([], files.PAGE), left(state(round_)), out)
    known = files.read_hashes(spark, o.cross_run_hashes) if o.cross_run_hashes else None
    day = F.to_timestamp(F.lit(o.crawled_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")))
    extension = "md" if o.form == "markdown" else "txt"
    fresh, rounds, paces = old is None, 0, {}
    try:
        while not o.max_pages or saved < o.max_pages:
            sets = state(round_)
            now = kept(spark, frontier.batch(left(sets), o.batch, saved, o.max_pages), "batch")
            if now.isEmpty():
                break
            web = kept(spark, fetched(now, client, o.threads, delay, paces=paces), "web")
            paces = paces | paces_of(web)
            html = web.where(pages.is_html(F.col("ok"), F.col("content_type")))
            body = pages.without_overlays(F.col("html")) if rendered else F.col("html")
            x = html.select("url", pages.extract(body, F.col("url"), o.form, o.keep_images, o.backend).alias("x"))
            good = kept(spark, x.select("url", "x.title", "x.content", "x.links").where(pages.enough_words(F.col("content"), o.min_words)), "extracted")
            spent = [now, web, good]
            if o.keep_images:
                images = kept(spark, stored_images(good, client, f"{out}/assets", o.min_image_bytes), "images")
                good = kept(spark, with_local_images(good, images), "illustrated")
                spent += [images, good]
            new = pages.keep_first(pages.new_content(good, sets["seen_content"]), order="url")
            if known is not None:
                new = pages.new_content(new, known)
            new = kept(spark, new, "saved")
            spent.append(new)
            full = new
            if clusters is not None:
                full = pages.with_cluster(full, clusters.withColumn("pattern_cluster_size", F.col("pattern_cluster_size").cast("int")))
            if render is not None:
                spent.append(kept(spark, screenshots(new, render, f"{out}/screenshots"), "shots"))
                full = full.join(spent[-1], "url", "left")
            rows = pages.page_rows(full, day, extension, title_at_top=o.title_at_top)
            if o.page_files:
                page = text.rendered_page(F.col("title"), F.col("url"), F.col("content"), urls.citation(F.col("title"), F.col("url"), day), day, extension == "md")
                files.write_files(new.select(urls.page_filename(F.col("url"), extension).alias("path"), page.alias("rendered")), f"{out}/files")
            files.write_pages(rows, rows_at, resume=not fresh)
            fresh = False
            saved += new.count()
            links = wanted(new.select(F.explode("links").alias("url")).distinct())
            links = frontier.candidates(frontier.candidates(links, sets["to_visit"]), now)
            score = None
            if o.prioritize_links:
                links, score = frontier.link_scores(links, frontier.yields(files.read_pages(spark, rows_at))), "score"
            hashes = new.select(text.content_hash(F.col("content")).alias("hash"))
            added = {"seen_urls": now.select("url"), "seen_content": hashes, "to_visit": place(links, score), "visited_for_links": new.select("url")}
            files.save_state(state_at, {n: t.coalesce(1) for n, t in added.items()}, saved, [start], round_ + 1)
            round_, rounds = round_ + 1, rounds + 1
            dropped(spark, *spent)
            tell(f"round {rounds}: {saved} pages")
    except KeyboardInterrupt:
        tell(f"interrupted after {saved} pages")
    sets = state(round_)
    if o.cross_run_hashes:
        files.append_hashes(spark, sets["seen_content"], o.cross_run_hashes)
    rest = kept(spark, left(sets), "frontier")
    if rest.isEmpty():
        files.drop_state(spark, state_at)
    return Result(saved, files.read_pages(spark, rows_at) if rounds or old else spark.createDataFrame([], files.PAGE), rest, out, rounds)


def crawl_sites(spark: SparkSession, seeds: list[str], out: str, client: Client, options: Options | None = None, **more) -> dict[str, Result | Exception]:
    """One crawl a seed, each into its own folder; a failed one doesn't stop the others."""
    named = frontier.site_directories(spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string")).collect()
    results: dict[str, Result | Exception] = {}
    for r in named:
        try:
            results[r["seed"]] = crawl(spark, r["seed"], f"{out}/{r['directory']}", client, options, **more)
        except Exception as e:  # reported to the caller by seed
            results[r["seed"]] = e
    return results
