"""Queries over what crawls keep and models give: files, sets, queues, replies; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import text, urls
from weftline.operators import enrich, frontier, pages
from weftline.plans import sql as S
from weftline.plans import web
from weftline.sources import files
from weftline.sources.tables import shared_dir


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored_pages(spark, sf_dir):
    """Index rows of even and odd pages, written as two sets of JSON lines and read as one, each with its source."""
    at = _place(spark, "stored")
    p = web.pages_of(spark, sf_dir)
    for name, rest in (("even", 0), ("odd", 1)):
        own = p.where(F.col("page_id") % 2 == rest).select("url", pages.fast_title(F.col("html")).alias("title"), text.visible_text(F.col("html")).alias("text"))
        files.write_pages(own, f"{at}/{name}")
    rows = files.read_pages(spark, [f"{at}/even", f"{at}/odd"])
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)/[^/]*$", 1)
    return rows.select("url", "title", F.sha1(F.col("text").cast("binary")).alias("text_sha1"), folder.alias("folder"))


def stored_hashes(spark, sf_dir):
    """The set of content hashes after two runs, over texts of all and of the longer documents."""
    at = _place(spark, "hashes")
    d = documents(spark, sf_dir).select(text.content_hash(F.col("text")).alias("hash"), F.length("text").alias("n"))
    files.append_hashes(spark, d.where("n > 1000"), at)
    files.append_hashes(spark, d, at)
    return files.read_hashes(spark, at)


def stored_state(spark, sf_dir):
    """A crawl's state after three rounds of pages by the remainder of their id."""
    at = _place(spark, "state")
    p = web.pages_of(spark, sf_dir).select((F.col("page_id") % 3).alias("r"), urls.normalized(F.col("url")).alias("url"), text.content_hash(F.col("html")).alias("hash"))
    for k in range(3):
        own = p.where(F.col("r") == k)
        seen = own.select("url")
        files.save_state(at, {"seen_urls": seen, "seen_content": own.select("hash"), "to_visit": seen, "visited_for_links": seen.limit(0)}, k, ["s"], k or None)
    state = files.load_state(spark, at)
    one = lambda name, column: state[name].select(F.lit(name).alias("set"), F.col(column).alias("member"))
    return one("seen_urls", "url").unionByName(one("seen_content", "hash")).unionByName(one("visited_for_links", "url"))


def first_of_source(spark, sf_dir):
    return pages.first_by(documents(spark, sf_dir).select("source", "doc_id", "lang"), "source", "doc_id")


def html_answers(spark, sf_dir):
    """Events as answers: whether each is an HTML page that was had."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("user_id") % 3 == 0, "Text/HTML; charset=utf-8").when(F.col("user_id") % 3 == 1, "application/pdf")
    return e.select("event_id", F.coalesce(pages.is_html(F.col("event_type") != "error", kind), F.lit(False)).alias("html"))


def charsets(spark, sf_dir):
    """Texts from Latin-1 bytes, and from UTF-8 bytes that are declared Latin-1."""
    t = F.col("text")
    sha = lambda c: F.sha1(c.cast("binary"))
    latin = files.decoded(F.encode(t, "ISO-8859-1"), F.lit("ISO-8859-1"))
    return documents(spark, sf_dir).select("doc_id", sha(latin).alias("latin_sha1"), sha(files.decoded(F.encode(t, "UTF-8"), F.lit("latin-1"))).alias("utf8_sha1"))


def rewritten_images(spark, sf_dir):
    """Texts with two images after them, of which one is stored."""
    shown = F.concat("text", F.lit("\n![One](http://i.com/1.png) and ![Two](http://j.com/"), "doc_id", F.lit(".png)"))
    return documents(spark, sf_dir).select("doc_id", F.sha1(text.rewrite_images(shown, F.create_map(F.lit("http://i.com/1.png"), F.lit("one.png"))).cast("binary")).alias("rewritten"))


def queue_by_score(spark, sf_dir):
    """The hundred links of highest expected yield."""
    stats = frontier.yields(web.pages_of(spark, sf_dir), words=text.word_count(text.visible_text(F.col("html"))))
    own = web.edges_of(spark, sf_dir).select(F.col("dst").alias("url")).distinct()
    scored = frontier.link_scores(own, stats).withColumn("score", F.round("score", 4))
    return frontier.batch(frontier.placed(scored, score="score"), 100).select("url", "score")


def seed_bypass(spark, sf_dir):
    """Globs with a seed that none includes."""
    p = web.pages_of(spark, sf_dir)
    seed = p.agg(F.max("url")).first()[0] or ""
    return p.select("page_id", urls.path_excluded(F.col("url"), ("/nowhere/*",), ("*/9*",), (seed,)).alias("excluded"))


def first_word_and_length(prompt: str) -> str:
    """A made-up model: the first word of the page and the number of its words."""
    words = prompt.split("=== page ===\n", 1)[1].split()
    return "Here:\n```json\n{\"first\": %s, \"words\": %d, \"more\": 1}\n```" % ("null" if not words else '"' + words[0].replace("\\", "\\\\").replace('"', '\\"') + '"', len(words))


def model_fields(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("url"), "text")
    found = enrich.merged(enrich.extract_fields(d, ["first", "words", "url"], first_word_and_length, "made-up"), ["first", "words", "url"])
    return found.select(F.col("url").cast("long").alias("doc_id"), "first", F.col("words").cast("long").alias("words"), "field_url", "extracted_by")


def inserted_rows(spark, sf_dir):
    """Rows that a writer was given, over all tasks."""
    d = documents(spark, sf_dir).select("doc_id", "lang")
    return enrich.insert(d, len).agg(F.sum("written").alias("written"))


QUERIES = {f.__name__: f for f in (stored_pages, stored_hashes, stored_state, first_of_source, html_answers, charsets, rewritten_images, queue_by_score, seed_bypass, model_fields, inserted_rows)}

ORACLE = {
    "stored_pages": f"SELECT url, {S.title('html')} AS title, sha1({S.visible('html')}) AS text_sha1, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS folder FROM pages",
    "stored_hashes": "SELECT DISTINCT sha1(text) AS hash FROM documents",
    "stored_state": f"SELECT 'seen_urls' AS \"set\", {S.normalized('url')} AS member FROM pages UNION ALL SELECT 'seen_content', sha1(html) FROM pages",
    "first_of_source": "SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1",
    "html_answers": "SELECT event_id, event_type <> 'error' AND user_id % 3 = 0 AS html FROM events",
    "charsets": "SELECT doc_id, sha1(text) AS latin_sha1, sha1(text) AS utf8_sha1 FROM documents",
    "rewritten_images": "SELECT doc_id, sha1(text || chr(10) || '![One](assets/one.png) and ![Two](http://j.com/' || doc_id || '.png)') AS rewritten FROM documents",
    "queue_by_score": f"SELECT url, score FROM ({web.ORACLE['link_scores']}) AS s ORDER BY score DESC, url LIMIT 100",
    "seed_bypass": f"SELECT page_id, regexp_matches({S.path('url')}, '/9') OR url <> (SELECT max(url) FROM pages) AS excluded FROM pages",
    "model_fields": f"SELECT doc_id, ({S.words('left(text, 8000)')})[1] AS first, {S.n_words('left(text, 8000)')} AS words, NULL::VARCHAR AS field_url, 'made-up' AS extracted_by FROM documents",
    "inserted_rows": "SELECT count(*)::BIGINT AS written FROM documents",
}
