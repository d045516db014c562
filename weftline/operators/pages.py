"""Pages: from raw HTML to clean, deduplicated page rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import dom, text, urls
from weftline.sources.tables import small_batches

EXTRACTED = "struct<title string, content string, links array<string>, page_type string, description string, json_ld array<string>>"
SIGNALS = "struct<docs_url boolean, article_url boolean, product_url boolean, forum_url boolean, n_pre int, has_code boolean, has_article boolean, has_time boolean, has_author boolean, has_price boolean, has_replies boolean>"
Extractor = Callable[[str, str | None], dict]
EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(name: str, extractor: Extractor) -> None:
    """Adds a backend: (html, url) to a dict with title and content, and links if it has any.
    Where it raises or finds nothing, the default extraction stands in."""
    EXTRACTORS[name] = extractor


READER_CHARS, READER_WORDS = 32_000, 10


def register_reader(complete: Callable[[str], str], name: str = "reader") -> None:
    """Adds a backend that has a language model write the Markdown of a page, of whose HTML it
    is given as much as fits its context; fewer than ten words count as no answer."""

    def read(html: str, url: str | None) -> dict | None:
        body = dom.tidy(complete(f"Rewrite this HTML page as clean Markdown, without navigation, and say nothing else:\n\n{html[:READER_CHARS]}") or "")
        return {"content": body} if len(body.split()) >= READER_WORDS else None

    register_extractor(name, read)


def custom(extractor: Extractor, html: str, url: str | None) -> dict:
    try:
        found = extractor(html, url)
    except Exception:  # a page that a plugged-in extractor can't take is extracted as usual
        found = None
    base = dom.extracted(html, url)
    return base | found if found and found.get("content") else base


def once(run):
    """The function, marked so that the optimizer evaluates it once a row: a condition on its
    result (an explode makes one, too) is else moved below the projection and parses each page
    again. Pages come in small batches."""
    small_batches()
    return run.asNondeterministic()


def extract(html: Column, url: Column | None = None, form: str = "markdown", keep_images: bool = False, backend: str = "default") -> Column:
    """Title, content, links, page type, description and JSON-LD of each page, from one parse.

    form is markdown or text; backend is default or the name of a registered extractor. A
    null page gives null."""
    if form not in ("markdown", "text"):
        raise ValueError("form is markdown or text")
    other = None if backend == "default" else EXTRACTORS[backend]

    @F.pandas_udf(EXTRACTED)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("title", "content", "links", "page_type", "description", "json_ld"))
        rows = [empty if h is None else custom(other, h, u) if other else dom.extracted(h, u, form, keep_images) for h, u in zip(pages, bases)]
        return pd.DataFrame(rows, columns=list(empty))

    return once(run)(html, F.lit(None).cast("string") if url is None else url)


def main_text(html: Column, url: Column) -> Column:
    """title and content of each page: the cleaned text of its main element or of all its
    articles, else of the region that extraction takes. A null page gives null."""

    @F.pandas_udf("struct<title string, content string>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if h is None else dom.main_text(h, u) for h, u in zip(pages, bases)], columns=["title", "content"])

    return once(run)(html, url)


def links(html: Column, url: Column) -> Column:
    """The links of extract() alone, without the work on the content. A null page gives null."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else dom.links(dom.parsed(h), u) for h, u in zip(pages, bases)], dtype=object)

    return once(run)(html, url)


def best_of(df: DataFrame, candidates: list[str], into: str = "content") -> DataFrame:
    """The candidate column of highest extraction score; the first of equals."""
    ranked = F.sort_array(F.array(*(F.struct((-F.coalesce(text.extraction_score(F.col(c)), F.lit(-1.0))).alias("s"), F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(candidates))))
    return df.withColumn(into, F.get(ranked, F.lit(0))["t"])


def page_signals(html: Column, url: Column) -> Column:
    """What the type of each page is judged by; a null page has none of it."""

    @F.pandas_udf(SIGNALS)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = [dom.signals(dom.parsed(h or ""), u or "") for h, u in zip(pages, bases)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SIGNALS[7:-1].split(", ")])

    return once(run)(html, url)


def page_type(s: Column) -> Column:
    """Type of a page by its signals: the first rule that holds."""
    return (
        F.when((s["docs_url"] & s["has_code"]) | (s["n_pre"] >= 3), "docs")
        .when((s["has_article"] | s["article_url"]) & (s["has_time"] | s["has_author"]), "article")
        .when(s["product_url"] & s["has_price"], "product")
        .when(s["forum_url"] & s["has_replies"], "forum")
        .when(s["docs_url"], "docs")
        .when(s["article_url"], "article")
        .otherwise("generic")
    )


def without_overlays(html: Column) -> Column:
    """The pages without dialogs, banners and the like."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: h if h is None else dom.without_overlays(h))

    return once(run)(html)


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def fast_title(html: Column) -> Column:
    """<title> by pattern, without a parse; the five basic entities are decoded."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)
    for entity, sign in ENTITIES:
        found = F.replace(found, F.lit(entity), F.lit(sign))
    return F.trim(found)


def is_html(ok: Column, content_type: Column) -> Column:
    return ok & F.contains(F.lower(content_type), F.lit("text/html"))


def enough_words(content: Column, least: int = 20) -> Column:
    return (content != "") & (text.word_count(content) >= least)


def keep_first(df: DataFrame, content: str = "content", order: str = "page_id") -> DataFrame:
    """Of rows with equal content hash, that which comes first; of rows that share hash and
    order value one; a null order value comes last. The groups carry the order and not the rows: the rows' keys are
    aggregated, then joined back. Rows with a null content stay.
    """
    keys = df.where(F.col(content).isNotNull()).groupBy(text.content_hash(F.col(content)).alias("weft_hash"), F.col(order).alias("weft_order")).agg(F.count("*").alias("weft_n"))
    first = keys.groupBy("weft_hash").agg(F.min(F.struct(F.col("weft_order").isNull().alias("weft_late"), "weft_order", "weft_n")).alias("weft_first"))
    first = first.select("weft_hash", "weft_first.weft_order", "weft_first.weft_n")
    marked = df.withColumn("weft_own", text.content_hash(F.col(content)))
    found = marked.join(first, (marked["weft_own"] == first["weft_hash"]) & marked[order].eqNullSafe(first["weft_order"]))
    once = found.where("weft_n = 1").unionByName(found.where("weft_n > 1").dropDuplicates(["weft_hash"])).select(*(marked[c] for c in df.columns))
    return once.unionByName(df.where(F.col(content).isNull()))


def new_content(df: DataFrame, seen: DataFrame, content: str = "content", hashes: str = "hash") -> DataFrame:
    """Rows whose content hash isn't in the table of seen ones."""
    return df.join(seen.select(F.col(hashes).alias("weft_seen")), text.content_hash(F.col(content)) == F.col("weft_seen"), "left_anti")


def page_rows(df: DataFrame, day: Column, extension: str = "md", tool: str = "weftline", title_at_top: bool = False) -> DataFrame:
    """Index rows (url, title, path, crawled_at, citation, tool, text) of url, title, content."""
    body = text.with_title(F.col("title"), F.col("content")) if title_at_top else F.col("content")
    return df.select(
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        urls.page_filename(F.col("url"), extension).alias("path"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("crawled_at"),
        urls.citation(F.col("title"), F.col("url"), day).alias("citation"),
        F.lit(tool).alias("tool"),
        body.alias("text"),
        *[c for c in ("images", "screenshot", "screenshot_error", "pattern", "pattern_cluster_size", "is_sample") if c in df.columns],
    )


def with_cluster(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pattern, cluster size and whether it was sampled, for the URLs that clusters has."""
    return rows.join(clusters.select("url", "pattern", "pattern_cluster_size", "is_sample"), "url", "left")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first by order: ordered distinct."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("weft_n", F.row_number().over(w)).where("weft_n = 1").drop("weft_n")


def structured_text(items: list[str]) -> str:
    return dom.structured_text([json.loads(i) for i in items])
