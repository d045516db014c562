"""Queries over pages: addresses, frontier, extraction, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text, urls
from weftline.operators import frontier, pages
from weftline.plans import sql
from weftline.sources.tables import kept

DAY = "2026-01-15 12:30:00"
SEED = "https://example.com/en/docs/guide/start.html"
INCLUDE, EXCLUDE = ("/en*", "/[a-d]*"), ("*/9*", "/fr/?")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def day() -> Column:
    return F.to_timestamp(F.lit(DAY))


def article(html: Column) -> Column:
    return text.visible_text(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)(?:</article>|\z)", 1))


def url_normalize(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", urls.normalized(F.col("url")).alias("normalized"))


def url_filenames(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select("page_id", urls.page_filename(u).alias("page_file"), urls.image_filename(u).alias("image_file"), urls.screenshot_filename(u).alias("screenshot_file"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select("page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.query(u).alias("query"), F.array_join(urls.segments(u), ">").alias("segments"), urls.section(u).alias("section"), urls.first_segment(u).alias("first_segment"), urls.site_directory(u).alias("directory"), urls.slug(u).alias("slug"))


def url_scope(spark, sf_dir):
    u = F.col("url")
    base = F.regexp_replace(urls.netloc(u), "^(www|blog|m)[.]", "")
    return pages_of(spark, sf_dir).select("page_id", urls.in_scope(u, base).alias("same_host"), urls.in_scope(u, base, True).alias("with_subdomains"))


def url_locales(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select("page_id", urls.locale_segment(u).alias("locale"), urls.foreign_locale(u).alias("excluded"))


def locale_counts(spark, sf_dir):
    return frontier.locale_counts(pages_of(spark, sf_dir))


def locale_confirmed(spark, sf_dir):
    return frontier.confirmed_locales(pages_of(spark, sf_dir))


def site_profile(spark, sf_dir):
    p = frontier.site_profile(pages_of(spark, sf_dir))
    return p.select("sample_size", F.array_join("confirmed_locales", ",").alias("confirmed"), F.array_join("i18n_non_primary", ",").alias("non_primary"), "has_i18n_variants", F.size("locale_counts").cast("long").alias("n_locales"))


def url_path_scope(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select("page_id", urls.path_scope(u).alias("scope"), F.round(urls.path_priority(u, F.lit(SEED)), 6).alias("priority"))


def url_globs(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", urls.path_excluded(F.col("url"), INCLUDE, EXCLUDE, i18n=True).alias("excluded"))


def url_citation(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", urls.citation(pages.fast_title(F.col("html")), F.col("url"), day()).alias("citation"))


def site_directories(spark, sf_dir):
    return frontier.site_directories(pages_of(spark, sf_dir).select("page_id", "url"), "url").select("page_id", "directory")


def section_clusters(spark, sf_dir):
    return frontier.section_sizes(pages_of(spark, sf_dir)).withColumn("is_templated", F.col("pattern_cluster_size") > 20)


def smart_sample(spark, sf_dir):
    return frontier.smart_sample(pages_of(spark, sf_dir).select("page_id", "url")).select("page_id", "pattern", "pattern_cluster_size", "is_sample")


def edges_of(spark, sf_dir):
    """Links by the DOM, resolved against the page's address; the SQL finds them by pattern."""
    x = pages_of(spark, sf_dir).select("page_id", "url", pages.links(F.col("html"), F.col("url")).alias("links"))
    return x.select("page_id", urls.normalized(F.col("url")).alias("src"), F.explode("links").alias("dst")).distinct()


def link_edges(spark, sf_dir):
    return edges_of(spark, sf_dir)


def link_indegree(spark, sf_dir):
    return edges_of(spark, sf_dir).groupBy("dst").agg(F.count_distinct("page_id").alias("n_pages"))


def frontier_round(spark, sf_dir):
    """Links of the saved pages that are in the scope of their page and not seen."""
    e = edges_of(spark, sf_dir).where(urls.in_scope(F.col("dst"), urls.netloc(F.col("src"))))
    seen = pages_of(spark, sf_dir).select(urls.normalized(F.col("url")).alias("url"))
    return frontier.candidates(e.select(F.col("dst").alias("url")).distinct(), seen)


def frontier_order(spark, sf_dir):
    """The round's links placed by likeness to the seed's path, the first 100 as a batch."""
    return frontier.batch(frontier.placed(frontier_round(spark, sf_dir), seed=SEED), 100).select("url", "band")


def bfs_reach(spark, sf_dir):
    """All addresses that following links finds from the hosts' roots: a root leads to the
    host's pages, as its sitemap would, and a page to its links."""
    u = F.col("url")
    p = pages_of(spark, sf_dir).select(urls.normalized(u).alias("url")).distinct()
    own = p.select(urls.normalized(F.concat(urls.scheme(u), F.lit("://"), urls.netloc(u), F.lit("/"))).alias("src"), u.alias("dst"))
    e = kept(spark, own.unionByName(edges_of(spark, sf_dir).select("src", "dst")).where("src <> dst").distinct(), "edges")
    return frontier.reached(spark, own.select(F.col("src").alias("url")), e)


def yield_stats(spark, sf_dir):
    return frontier.yields(pages_of(spark, sf_dir), words=text.word_count(text.visible_text(F.col("html"))))


def link_scores(spark, sf_dir):
    stats = frontier.yields(pages_of(spark, sf_dir), words=text.word_count(text.visible_text(F.col("html"))))
    own = edges_of(spark, sf_dir).select(F.col("dst").alias("url")).distinct()
    return frontier.link_scores(own, stats).select("url", F.round("score", 4).alias("score"))


def visible_text(spark, sf_dir):
    h = F.col("html")
    return pages_of(spark, sf_dir).select("page_id", text.visible_text(h).alias("visible"), text.is_spa(h).alias("is_spa"))


def page_titles(spark, sf_dir):
    x = pages.extract(F.col("html"), F.col("url"))
    return pages_of(spark, sf_dir).select("page_id", x["title"].alias("title"))


def page_links(spark, sf_dir):
    """Links by the DOM; the SQL finds them by pattern."""
    x = pages_of(spark, sf_dir).select("page_id", pages.extract(F.col("html"), F.col("url"))["links"].alias("links"))
    return x.select("page_id", F.explode("links").alias("dst"))


def page_content(spark, sf_dir):
    x = pages_of(spark, sf_dir).select("page_id", pages.extract(F.col("html"), F.col("url")).alias("x"))
    return x.select("page_id", "x.title", "x.content", "x.page_type", "x.description", F.array_join("x.links", "\n").alias("links"))


def page_text(spark, sf_dir):
    x = pages.extract(F.col("html"), F.col("url"), "text")
    return pages_of(spark, sf_dir).select("page_id", x["content"].alias("content"))


def page_types(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", pages.page_signals(F.col("html"), F.col("url")).alias("s")).select("page_id", pages.page_type(F.col("s")).alias("page_type"))


def overlays(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", text.visible_text(pages.without_overlays(F.col("html"))).alias("visible"))


def extraction_ensemble(spark, sf_dir):
    """The better of the Markdown and the plain-text extraction of each page."""
    p = pages_of(spark, sf_dir).select("page_id", pages.extract(F.col("html"), F.col("url"))["content"].alias("a"), article(F.col("html")).alias("b"))
    return pages.best_of(p, ["a", "b"]).select("page_id", "content", text.rounded(text.extraction_score(F.col("content")), 3).alias("score"))


def articles(spark, sf_dir):
    """Title and main text of each page by the DOM; the SQL takes the one article by pattern."""
    x = pages_of(spark, sf_dir).select("page_id", "url", pages.main_text(F.col("html"), F.col("url")).alias("x"))
    return x.select("page_id", "url", "x.title", "x.content")


def page_rows(spark, sf_dir):
    """The flagship: pages to clean, deduplicated index rows."""
    rows = kept(spark, articles(spark, sf_dir).withColumn("url", urls.normalized(F.col("url"))).where(pages.enough_words(F.col("content"))), "articles")
    return pages.page_rows(pages.keep_first(rows), day())


def rendered_pages(spark, sf_dir):
    c = urls.citation(F.col("title"), F.col("url"), day())
    a = articles(spark, sf_dir)
    return a.select("page_id", *(F.sha1(text.rendered_page(F.col("title"), F.col("url"), F.col("content"), c, day(), m).cast("binary")).alias(n) for n, m in (("markdown_sha1", True), ("text_sha1", False))))


def dedup_exact(spark, sf_dir):
    return pages.keep_first(kept(spark, articles(spark, sf_dir), "articles")).select("page_id", text.content_hash(F.col("content")).alias("hash"))


def dedup_incremental(spark, sf_dir):
    """The first half of the ids is the run before: its hashes are the persisted set."""
    a = kept(spark, articles(spark, sf_dir), "articles").crossJoin(F.broadcast(pages_of(spark, sf_dir).agg(F.avg("page_id").alias("mid"))))
    seen = a.where("page_id < mid").select(text.content_hash(F.col("content")).alias("hash")).distinct()
    return pages.keep_first(pages.new_content(a.where("page_id >= mid"), seen)).select("page_id")


def cluster_join(spark, sf_dir):
    rows = pages_of(spark, sf_dir).select("page_id", "url")
    return pages.with_cluster(rows, frontier.smart_sample(pages_of(spark, sf_dir).select("url"))).select("page_id", "pattern", "pattern_cluster_size", "is_sample")


def word_counts(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("page_id", text.word_count(F.col("content")).alias("words"), pages.enough_words(F.col("content")).alias("kept"))


QUERIES = {f.__name__: f for f in (url_normalize, url_filenames, url_parts, url_scope, url_locales, locale_counts, locale_confirmed, site_profile, url_path_scope, url_globs, url_citation, site_directories, section_clusters, smart_sample, link_edges, link_indegree, frontier_round, frontier_order, bfs_reach, yield_stats, link_scores, visible_text, page_titles, page_links, page_content, page_text, page_types, overlays, extraction_ensemble, page_rows, rendered_pages, dedup_exact, dedup_incremental, cluster_join, word_counts)}

# --- SQL

U = "url"
S = sql
LONG_DAY = "January 15, 2026"
ARTICLES = f"SELECT page_id, url, {S.title('html')} AS title, {S.article('html')} AS content FROM pages"


def _citation(t: str = "title", u: str = "url") -> str:
    return f"(CASE WHEN coalesce({t}, '') = '' THEN 'Untitled' ELSE {t} END || '. ' || {S.part(u, 2)} || '. Available at: ' || {u} || ' [Accessed {LONG_DAY}].')"


def _rendered(head: str, mark: str) -> str:
    return f"(CASE WHEN coalesce(title, '') <> '' THEN '{head}' || title || chr(10) || chr(10) ELSE '' END || '{mark}URL: ' || url || chr(10) || '{mark}Crawled: {LONG_DAY}' || chr(10) || '{mark}Citation: ' || {_citation()} || chr(10) || chr(10) || content || chr(10))"


BASE = f"regexp_replace({S.netloc(U)}, '^(www|blog|m)[.]', '')"
COUNTS = f"SELECT locale, count(*) AS n FROM (SELECT {S.locale(U)} AS locale FROM pages) AS l WHERE locale IS NOT NULL GROUP BY locale"
CONFIRMED = f"SELECT locale, n FROM (SELECT *, count(*) OVER () AS k FROM ({COUNTS}) AS c WHERE n >= 3) AS d WHERE k >= 2"
RAW = S.segments(U, True)
TRIM = f"rtrim({S.path(U)}, '/')"
FILE = f"regexp_matches(lower(regexp_extract({TRIM}, '[^/]*$')), '\\.(html?|php|aspx?|jsp)$')"
BARE = f"list_filter(string_split(regexp_replace(CASE WHEN {FILE} THEN regexp_replace({TRIM}, '[^/]*$', '') ELSE {S.path(U)} END, '/index(\\.html?|\\.php)?$', ''), '/'), lambda s: s <> '')"
SHELVES = "'cat', 'categories', 'category', 'collections', 'products', 'shop'"
DEEPEST = f"list_max(list_filter(range(1, len({RAW}) + 1), lambda i: lower(({RAW})[i]) IN ({SHELVES})))"
SEED_PARTS = ["en", "docs", "guide", "start.html"]
PRIORITY = "CASE " + " ".join(f"WHEN ({RAW})[1:{k}] = [{S.quoted(SEED_PARTS[:k])}] THEN {k / 4}" for k in (4, 3, 2, 1)) + " ELSE 0.0 END"
VISIBLE_WORDS = S.n_words(S.visible("html"))
STATS = f"SELECT {S.first_segment(U)} AS segment, sum({VISIBLE_WORDS})::BIGINT AS total_words, count(*) AS pages FROM pages GROUP BY 1"
SIZED = f"SELECT page_id, url, {S.section(U)} AS pattern, count(*) OVER (PARTITION BY {S.section(U)}) AS pattern_cluster_size FROM pages"
SAMPLED = f"SELECT page_id, url, pattern, pattern_cluster_size, pattern_cluster_size > 20 AS is_sample FROM ({SIZED}) AS s QUALIFY pattern_cluster_size <= 20 OR row_number() OVER (PARTITION BY pattern ORDER BY sha1(url), url) <= 5"
ROUND = f"SELECT DISTINCT dst AS url FROM ({S.EDGES}) AS e WHERE {S.netloc('dst')} = {S.netloc('src')} AND dst NOT IN (SELECT {S.normalized(U)} FROM pages)"
MARKS = " OR ".join(f"contains(html, '{m}')" for m in ('__NUXT__', 'data-qwik', 'data-reactroot', 'id="___gatsby"', 'id="__next"', 'id="app"', 'id="root"', 'ng-version='))
SPA = f"(html <> '' AND ({MARKS}) AND length({S.visible('html')}) < 400 AND length({S.visible('html')}) / length(html) < 0.05)"
PATH = S.stripped_path(U)
DOCLIKE = "'api', 'article', 'blog', 'doc', 'docs', 'getting-started', 'guide', 'learn', 'manual', 'post', 'reference', 'tutorial'"
SCORE = f"""CASE WHEN contains(regexp_extract({PATH}, '[^/]*$'), '.') AND lower(regexp_extract({PATH}, '[^./]*$')) NOT IN ('', 'asp', 'aspx', 'htm', 'html', 'jsp', 'php') THEN base * 0.1
  ELSE base * greatest(0.3, 1.0 - (CASE WHEN {PATH} = '' THEN 0 ELSE len(string_split({PATH}, '/')) END) * 0.05::DOUBLE) * CASE WHEN len(list_intersect(string_split(lower({PATH}), '/'), [{DOCLIKE}])) > 0 THEN 1.3 ELSE 1.0 END END"""
IN_RE = "(?s)^/(?:en|[a-d]).*$"
EX_RE = "(?s)^(?:.*/9.*|/fr/.)$"
KEPT = f"SELECT * FROM ({ARTICLES}) AS a QUALIFY row_number() OVER (PARTITION BY sha1(content) ORDER BY page_id) = 1"
HALF = "(SELECT avg(page_id) FROM pages)"
ROOT = f"{S.scheme(U)} || '://' || {S.netloc(U)} || '/'"

# The made-up pages have one article of a heading and paragraphs, some of which are bold up to a line break.
TEXTLIKE = {sign: entity for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))}


def decoded(t: str) -> str:
    for sign, entity in TEXTLIKE.items():
        t = f"replace({t}, '{entity}', '{sign}')"
    return t


INNER = "regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"
BITS = f"list_filter(list_transform(regexp_split_to_array({INNER}, '</?(?:h1|p)>'), lambda x: trim(x)), lambda x: x <> '')"
MARKED = f"list_transform({BITS}, lambda x, i: CASE WHEN i = 1 THEN '# ' || x WHEN starts_with(x, '<b>') THEN '**' || trim(regexp_replace(x, '</?b>|<br>', '', 'g')) || '**' ELSE x END)"
# An article of fewer than 25 words isn't taken for the main region, so the page's box is content, too.
ARTICLE_ROWS = f"list_transform({BITS}, lambda x: trim(regexp_replace(regexp_replace(x, '</?b>|<br>', ' ', 'g'), '\\s+', ' ', 'g')))"
BOX = "regexp_extract(html, '(?is)<div class=\"ad\">(.*?)</div>', 1)"
SHORT = f"{S.n_words(f'array_to_string({ARTICLE_ROWS}, chr(32))')} < 25"
MARKDOWN = decoded(f"(CASE WHEN {SHORT} THEN trim(regexp_replace({BOX}, '\\s+', ' ', 'g')) || chr(10) || chr(10) ELSE '' END || array_to_string({MARKED}, chr(10) || chr(10)))")
ROWS_OF_TEXT = f"(CASE WHEN {SHORT} THEN list_concat(list_transform(string_split({BOX}, chr(10)), lambda x: trim(x)), {ARTICLE_ROWS}) ELSE {ARTICLE_ROWS} END)"
PLAIN = decoded(f"array_to_string(list_filter({ROWS_OF_TEXT}, lambda x, i: i = 1 OR x <> ({ROWS_OF_TEXT})[i - 1]), chr(10))")


def stem(*names: str) -> str:
    return f"regexp_matches(lower({S.path(U)}), '/(?:{'|'.join(names)})')"


def classed(names: str) -> str:
    return f"regexp_matches(html, '(?i)class=\"[^\"]*(?:{names})')"


DOCS, POSTS = stem("doc", "api", "reference", "guide", "tutorial", "manual", "sdk", "specification"), stem("blog", "post", "article", "news", "story", "journal")
TYPE = f"""CASE WHEN ({DOCS} AND regexp_matches(html, '<(pre|code)\\b')) OR len(regexp_extract_all(html, '<pre\\b')) >= 3 THEN 'docs'
  WHEN (contains(html, '<article') OR {POSTS}) AND (contains(html, '<time') OR regexp_matches(html, 'rel="[^"]*\\bauthor\\b') OR {classed('author|byline')}) THEN 'article'
  WHEN {stem("product", "item", "shop", "store", "buy", "pricing", "catalog")} AND regexp_matches(left({S.visible(f"regexp_extract(html, '(?is)<body.*')")}, 2000), '[0-9]\\.[0-9]{{2}}|[$][0-9]') THEN 'product'
  WHEN {stem("forum", "thread", "discussion", "community", "topic", "question", "answer", "ask")} AND {classed('reply|comment|answer|post')} THEN 'forum'
  WHEN {DOCS} THEN 'docs' WHEN {POSTS} THEN 'article' ELSE 'generic' END"""
DESCRIPTION = "trim(regexp_extract(html, '(?is)<meta name=\"description\" content=\"([^\"]*)\"', 1))"
CLOSED = """regexp_matches(rtrim(ws[i], chr(34) || chr(39) || ')]}}>'), '[.!?]$')"""


def score_of(t: str) -> str:
    """Extraction score of a text, from its words, links, sentences, headings and paragraphs."""
    own = f"list_filter(list_transform(regexp_split_to_array({t}, '[.!?]+'), lambda s: trim(s, chr(32) || chr(10) || chr(9) || chr(13))), lambda s: s <> '')"
    n = f"{S.n_words(t)}"
    return f"""CASE WHEN {n} > 0 THEN {n} * 0.3::DOUBLE + (1 - len(regexp_extract_all({t}, '\\[.*?\\]\\(.*?\\)')) / {n}) * 0.3::DOUBLE
      + least(coalesce(list_sum(list_transform({own}, lambda s: {S.n_words('s')})), 0) / greatest(len({own}), 1) / 20, 1.0) * 0.2::DOUBLE + (regexp_matches({t}, '(?m)^#{{1,6}}\\s+')::INT + contains({t}, chr(10) || chr(10))::INT) * 0.1::DOUBLE ELSE 0.0 END"""


def word_chunks(source: str, keys: str, most: int, overlap: int) -> str:
    """(keys, idx, total, chunk) of a table (keys, text): windows of words that end with a sentence if one ends in their last fifth."""
    end = f"CASE WHEN target >= len(ws) THEN target ELSE coalesce(list_max(list_filter(range(greatest(target - {max(most // 5, 10)}, lo + 1), target + 1), lambda i: {CLOSED.replace('}}', '}')})), target) END"
    return f"""WITH RECURSIVE d AS (SELECT {keys}, text, {S.words('text')} AS ws FROM ({source}) AS src), step AS (
      SELECT {keys}, ws, 0::BIGINT AS idx, 0::BIGINT AS lo, least({most}, len(ws))::BIGINT AS target FROM d WHERE len(ws) > {most}
      UNION ALL SELECT {keys}, ws, idx + 1, nxt, least(nxt + {most}, len(ws)) FROM (SELECT *, CASE WHEN hi <> target THEN hi ELSE greatest(hi - {overlap}, lo + 1) END AS nxt FROM (SELECT *, {end} AS hi FROM step) AS s) AS t WHERE hi < len(ws))
      SELECT {keys}, idx, count(*) OVER (PARTITION BY {keys}) AS total, array_to_string(ws[lo + 1:hi], ' ') AS chunk FROM (SELECT *, {end} AS hi FROM step) AS f
      UNION ALL SELECT {keys}, 0, 1, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) FROM d WHERE len(ws) BETWEEN 1 AND {most}"""


ORACLE = {
    "url_normalize": f"SELECT page_id, {S.normalized(U)} AS normalized FROM pages",
    "url_filenames": f"SELECT page_id, {S.page_filename(U)} AS page_file, {S.image_filename(U)} AS image_file, {S.screenshot_filename(U)} AS screenshot_file FROM pages",
    "url_parts": f"""SELECT page_id, {S.scheme(U)} AS scheme, {S.netloc(U)} AS netloc, {S.path(U)} AS path, {S.query(U)} AS query, array_to_string({S.segments(U)}, '>') AS segments, {S.section(U)} AS section,
      {S.first_segment(U)} AS first_segment, CASE WHEN split_part({S.netloc(U)}, ':', 1) = '' THEN 'unknown' ELSE split_part({S.netloc(U)}, ':', 1) END AS directory, left(replace(regexp_replace(url, '^https?://', ''), '/', '_'), 50) AS slug FROM pages""",
    "url_scope": f"SELECT page_id, {S.netloc(U)} = {BASE} AS same_host, {S.netloc(U)} = {BASE} OR ends_with({S.netloc(U)}, '.' || {BASE}) AS with_subdomains FROM pages",
    "url_locales": f"SELECT page_id, {S.locale(U)} AS locale, {S.foreign(U)} AS excluded FROM pages",
    "locale_counts": COUNTS,
    "locale_confirmed": CONFIRMED,
    "site_profile": f"""SELECT (SELECT count(*) FROM pages) AS sample_size, coalesce(string_agg(locale, ',' ORDER BY locale), '') AS confirmed, coalesce(string_agg(locale, ',' ORDER BY locale) FILTER ({S.language('locale')} <> 'en'), '') AS non_primary,
      count(*) FILTER ({S.language('locale')} <> 'en') > 0 AS has_i18n_variants, (SELECT count(*) FROM ({COUNTS}) AS c) AS n_locales FROM ({CONFIRMED}) AS x""",
    "url_path_scope": f"""SELECT page_id, CASE WHEN lower(({RAW})[1]) IN ('wiki', 'wikipedia') OR {DEEPEST} = 1 THEN NULL WHEN {DEEPEST} > 1 THEN '/' || array_to_string(({RAW})[1:{DEEPEST} - 1], '/') || '/*'
      WHEN len({BARE}) >= 2 THEN '/' || array_to_string({BARE}, '/') || '/*' END AS scope, ({PRIORITY})::DOUBLE AS priority FROM pages""",
    "url_globs": f"SELECT page_id, {S.foreign(U)} OR regexp_matches({S.path(U)}, '{EX_RE}') OR NOT regexp_matches({S.path(U)}, '{IN_RE}') AS excluded FROM pages",
    "url_citation": f"SELECT page_id, {_citation(S.title('html'))} AS citation FROM pages",
    "site_directories": f"""SELECT page_id, host || CASE WHEN count(*) OVER (PARTITION BY host) > 1 AND tail <> '' THEN '_' || tail ELSE '' END AS directory
      FROM (SELECT page_id, CASE WHEN split_part({S.netloc(U)}, ':', 1) = '' THEN 'unknown' ELSE split_part({S.netloc(U)}, ':', 1) END AS host, regexp_replace({PATH}, '[^A-Za-z0-9._-]+', '_', 'g') AS tail FROM pages) AS h""",
    "section_clusters": f"SELECT {S.section(U)} AS pattern, count(*) AS pattern_cluster_size, count(*) > 20 AS is_templated FROM pages GROUP BY 1",
    "smart_sample": f"SELECT page_id, pattern, pattern_cluster_size, is_sample FROM ({SAMPLED}) AS s",
    "link_edges": S.EDGES,
    "link_indegree": f"SELECT dst, count(DISTINCT page_id) AS n_pages FROM ({S.EDGES}) AS e GROUP BY dst",
    "frontier_round": ROUND,
    "frontier_order": f"SELECT url, CASE WHEN ({PRIORITY}) >= 0.5 THEN 0 ELSE 2 END AS band FROM ({ROUND}) AS r ORDER BY band, url LIMIT 100",
    "bfs_reach": f"""WITH RECURSIVE p AS (SELECT {S.normalized(U)} AS url FROM pages), own AS (SELECT DISTINCT {S.normalized(ROOT)} AS src, url AS dst FROM p),
      e AS (SELECT src, dst FROM own WHERE src <> dst UNION SELECT src, dst FROM ({S.EDGES}) AS l WHERE src <> dst),
      walk AS (SELECT src AS url, 0 AS depth FROM own UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON e.src = walk.url WHERE walk.depth < 40)
      SELECT url, min(depth) AS depth FROM walk WHERE url IS NOT NULL GROUP BY url""",
    "yield_stats": f"SELECT *, round(total_words / pages, 1) AS avg_words FROM ({STATS}) AS s",
    "link_scores": f"""SELECT url, round({SCORE}, 4) AS score FROM (SELECT d.url, coalesce(s.total_words / s.pages, 200.0)::DOUBLE AS base FROM (SELECT DISTINCT dst AS url FROM ({S.EDGES}) AS e) AS d
      LEFT JOIN ({STATS}) AS s ON s.segment = {S.first_segment('d.url')}) AS b""",
    "visible_text": f"SELECT page_id, {S.visible('html')} AS visible, {SPA} AS is_spa FROM pages",
    "page_titles": f"SELECT page_id, {S.title('html')} AS title FROM pages",
    "page_links": f"SELECT DISTINCT page_id, dst FROM ({S.EDGES}) AS e",
    "page_content": f"SELECT p.page_id, {S.title('html')} AS title, CASE WHEN {DESCRIPTION} <> '' THEN '*' || {DESCRIPTION} || '*' || chr(10) || chr(10) ELSE '' END || {MARKDOWN} AS content, {TYPE} AS page_type, {DESCRIPTION} AS description, coalesce(l.links, '') AS links FROM pages AS p LEFT JOIN (SELECT page_id, string_agg(dst, chr(10) ORDER BY dst) AS links FROM (SELECT DISTINCT page_id, dst FROM ({S.EDGES}) AS e) AS d GROUP BY page_id) AS l ON l.page_id = p.page_id",
    "page_text": f"SELECT page_id, {PLAIN} AS content FROM pages",
    "page_types": f"SELECT page_id, {TYPE} AS page_type FROM pages",
    "overlays": f"SELECT page_id, replace(replace(replace(replace({S.visible('html')}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&#39;', chr(39)) AS visible FROM pages",
    "extraction_ensemble": f"SELECT page_id, CASE WHEN sb > sa THEN b ELSE a END AS content, round(greatest(sa, sb), 3) AS score FROM (SELECT *, {score_of('a')} AS sa, {score_of('b')} AS sb FROM (SELECT page_id, {MARKDOWN} AS a, {S.article('html')} AS b FROM pages) AS x) AS y",
    "page_rows": f"""SELECT url, title, {S.page_filename(U)} AS path, '2026-01-15T12:30:00Z' AS crawled_at, {_citation()} AS citation, 'weftline' AS tool, content AS text
      FROM (SELECT page_id, {S.normalized(U)} AS url, title, content FROM ({ARTICLES}) AS a WHERE {S.n_words('content')} >= 20) AS n QUALIFY row_number() OVER (PARTITION BY sha1(content) ORDER BY page_id) = 1""",
    "rendered_pages": f"SELECT page_id, sha1({_rendered('# ', '> ')}) AS markdown_sha1, sha1({_rendered('Title: ', '')}) AS text_sha1 FROM ({ARTICLES}) AS a",
    "dedup_exact": f"SELECT page_id, sha1(content) AS hash FROM ({KEPT}) AS k",
    "dedup_incremental": f"SELECT page_id FROM ({ARTICLES}) AS a WHERE page_id >= {HALF} AND sha1(content) NOT IN (SELECT sha1(content) FROM ({ARTICLES}) AS b WHERE page_id < {HALF}) QUALIFY row_number() OVER (PARTITION BY sha1(content) ORDER BY page_id) = 1",
    "cluster_join": f"SELECT p.page_id, s.pattern, s.pattern_cluster_size, s.is_sample FROM pages AS p LEFT JOIN ({SAMPLED}) AS s ON s.url = p.url",
    "word_counts": f"SELECT page_id, {S.n_words('content')} AS words, content <> '' AND {S.n_words('content')} >= 20 AS kept FROM ({ARTICLES}) AS a",
}
