"""Queries over documents, embeddings, events and conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import chunking, text
from weftline.operators import enrich, evaluate, pages, search
from weftline.plans import sql as S
from weftline.plans import web
from weftline.sources import robots
from weftline.streaming import throttle

ASKED = "the time and people"
FIELDS = ["company_name", "pricing"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def doc_words(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", text.word_count(t).alias("words"), pages.enough_words(t).alias("kept"), text.content_hash(t).alias("hash"))


def doc_cleaned(spark, sf_dir):
    t = F.col("text")
    sha = lambda c: F.sha1(c.cast("binary"))
    return documents(spark, sf_dir).select("doc_id", sha(text.compact_blank_lines(t)).alias("compact"), sha(text.clean_markdown(t)).alias("cleaned"), sha(text.strip_links(t)).alias("unlinked"))


def doc_structure(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", text.first_h1(t).alias("h1"), F.sha1(text.first_paragraph(t).cast("binary")).alias("lead"), F.size(text.paragraphs(t)).cast("long").alias("paragraphs"), F.sha1(F.array_join(text.paragraphs(t), "\x1e").cast("binary")).alias("paragraph_sha1"), text.section_heading(t).alias("heading"), F.array_join(F.transform(text.image_references(t), lambda r: r["url"]), " ").alias("images"))


def doc_sentences(spark, sf_dir):
    own = text.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(own).cast("long").alias("sentences"), F.sha1(F.array_join(own, "\x1e").cast("binary")).alias("sentence_sha1"))


def doc_scores(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.rounded(text.extraction_score(F.col("text")), 6).alias("score"))


def doc_adaptive(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.adaptive_words(F.col("text")).cast("long").alias("max_words"))


def doc_titled(spark, sf_dir):
    d = documents(spark, sf_dir)
    title, t = F.concat(F.lit("Document "), F.col("doc_id")), F.col("text")
    return d.select("doc_id", F.sha1(text.with_title(title, t).cast("binary")).alias("titled"), text.breadcrumb(F.col("source"), F.array(F.col("source"), F.col("lang")), t).alias("breadcrumb"))


def doc_prompts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha1(enrich.field_prompt(F.col("text"), F.col("source"), FIELDS).cast("binary")).alias("prompt"))


def extraction_diagnostics(spark, sf_dir):
    """Per-document measures summed up by source; the number of chunks is left to `evaluate`."""
    d = evaluate.diagnostics(documents(spark, sf_dir).select("source", "text"), "text")
    sums = (("n_words", "total_words"), ("n_headings", "headings"), ("n_fences", "fences"), ("nav_words", "nav_words"))
    return d.groupBy("source").agg(F.count("*").alias("pages"), *(F.sum(c).alias(n) for c, n in sums), F.count_if("has_paragraphs").alias("with_paragraphs"), F.round(F.avg("n_words"), 1).alias("avg_words"))


def keyword_search(spark, sf_dir):
    a = web.articles(spark, sf_dir).withColumnRenamed("content", "text")
    return search.keyword_search(a, ASKED, 10, "page_id").select("page_id", "score", "snippet")


def keyword_search_agent(spark, sf_dir):
    """Over documents, with the longer snippet."""
    d = documents(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
    return search.keyword_search(d, ASKED, 10, "doc_id", 100, 200).select("doc_id", "score", "snippet")


def page_lookup(spark, sf_dir):
    """The first page of the table's greatest address, asked for in capitals and with a slash."""
    p = table(spark, sf_dir, "pages")
    asked = p.agg(F.max("url")).first()[0] or ""
    return search.find_page(p, asked.upper() + "/", "page_id").select("page_id", "url")


def page_list(spark, sf_dir):
    return search.listing(web.articles(spark, sf_dir).withColumnRenamed("content", "text")).select("url", "title", "words")


def chunk_words(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.explode(chunking.chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.index").cast("long").alias("chunk_index"), F.col("c.total").cast("long").alias("chunk_total"), F.sha1(F.col("c.text").cast("binary")).alias("chunk"))


def chunk_markdown(spark, sf_dir):
    x = web.pages_of(spark, sf_dir).select("page_id", pages.extract(F.col("html"), F.col("url")).alias("x"))
    c = x.select("page_id", F.explode(chunking.chunks(F.col("x.content"), F.col("x.title"), F.lit(True), 60, 10, adaptive=False)).alias("c"))
    return c.select("page_id", "c.*")


def chunk_semantic(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.explode(chunking.chunks(F.col("text"), embed=enrich.hashing_embedder, meaning=True)).alias("c"))
    return d.select("doc_id", "c.*")


def semantic_breaks(spark, sf_dir):
    """Runs of alike neighbours, the embeddings of a label being its document's sentences."""
    e = vectors(spark, sf_dir)
    return enrich.semantic_breaks(e, "label", "id", "vector", 0.0).select("id", "label", F.col("run").cast("long").alias("run"))


def vector_rows(spark, sf_dir):
    rows = web.page_rows(spark, sf_dir)
    v = enrich.vector_rows(rows)
    return v.select("url", "chunk_index", "chunk_total", F.sha1(F.col("chunk_text").cast("binary")).alias("chunk"), F.size("embedding").alias("dims"))


def vector_topk(spark, sf_dir):
    """The nearest to the vector of the least id."""
    e = vectors(spark, sf_dir)
    probe = e.orderBy("id").first()
    rounded = search.nearest(e.withColumn("vector", F.col("vector").cast("array<double>")), list(probe["vector"]) if probe else [0.0], 10, "vector")
    return rounded.select("id", F.round("similarity", 6).alias("similarity"))


def rank_of_match(spark, sf_dir):
    """For each vector whose id is divisible by 100 the place of the nearest other vector
    with its label, among all vectors."""
    return search.match_ranks(vectors(spark, sf_dir), chosen=F.col("id") % 100 == 0)


def mrr(spark, sf_dir):
    return search.rank_metrics(rank_of_match(spark, sf_dir))


def rank_of_match_all(spark, sf_dir):
    """rank_of_match with every vector as a query."""
    return search.match_ranks(vectors(spark, sf_dir))


def mrr_all(spark, sf_dir):
    return search.rank_metrics(rank_of_match_all(spark, sf_dir))


def span_first_document(spark, sf_dir):
    """For each benchmark passage the least doc_id whose text contains it, case apart."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span"))
    d = documents(spark, sf_dir).select("doc_id", "text")
    return search.first_containing(b, d, "span", "text", "doc_id").select("item_id", F.col("first_index").alias("first_doc"))


def bm25(spark, sf_dir):
    return search.bm25(spark, documents(spark, sf_dir), ASKED, "doc_id").select("doc_id", F.round("bm25", 6).alias("bm25"))


def hybrid_retrieval(spark, sf_dir):
    """Documents with the embedding of their id: cosine to one vector blended with BM25."""
    e = vectors(spark, sf_dir).select("id", F.col("vector").alias("embedding"))
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return search.hybrid(spark, d.join(e, "id"), ASKED, [(-1) ** i * (i % 7) / 7 for i in range(64)]).select("id", F.round("score", 6).alias("score"))


def _answers(spark, sf_dir):
    """Events as answers of the user's host: error is 429, the value gives the seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), (F.col("value") / 100).alias("seconds"))


def throttle_delays(spark, sf_dir):
    return throttle.delays(_answers(spark, sf_dir), "user_id", "event_id", base=0.25).select("user_id", "event_id", F.round(F.col("delay") + 1e-9, 6).alias("delay"))


def response_means(spark, sf_dir):
    return throttle.rolling_mean(_answers(spark, sf_dir), "user_id", "event_id").select("event_id", F.round("mean_seconds", 6).alias("mean_seconds"))


def spread_sample(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source").where("source is not null")
    return search.spread_sample(d, 20, "source", "doc_id").select("doc_id")


def source_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


def conversation_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))
    x = c.select("conv_id", F.explode(chunking.chunks(F.col("text"), most=60, overlap=10)).alias("c"))
    return x.select("conv_id", "c.index", "c.total", "c.text")


def robots_sitemaps(spark, sf_dir):
    """Sitemap lines of a robots.txt made for each host of the pages."""
    hosts = web.pages_of(spark, sf_dir).select(web.urls.netloc(F.col("url")).alias("host")).distinct()
    r = hosts.withColumn("robots", F.concat(F.lit("User-agent: *\nDisallow: /x\n# note\nSiteMap: https://"), F.col("host"), F.lit("/sitemap.xml\nsitemap:https://"), F.col("host"), F.lit("/news.xml")))
    return r.select("host", F.explode(robots.sitemaps(F.col("robots"))).alias("sitemap"))


def robots_allowed(spark, sf_dir):
    p = web.pages_of(spark, sf_dir)
    return p.select("page_id", robots.allowed(F.col("url"), F.lit("User-agent: *\nDisallow: /fr/\nAllow: /\n")).alias("allowed"))


def replies(spark, sf_dir):
    """Conversation turns as a model's replies: fenced JSON made from them and read again."""
    c = table(spark, sf_dir, "conversations")
    made = F.concat(F.lit("Here:\n```json\n{\"turn\": "), F.col("turn"), F.lit("}\n```\nDone."))
    return c.select("conv_id", "turn", F.get_json_object(enrich.json_of_reply(made), "$.turn").cast("long").alias("read"), enrich.json_of_reply(F.concat(F.lit("no "), F.col("role"))).alias("unread"))


def regression_guards(spark, sf_dir):
    """Measures by language, of all documents before and of those of 50 words or more after."""
    d = documents(spark, sf_dir).select("lang", text.word_count(F.col("text")).alias("w"))
    made = lambda x: x.groupBy(F.col("lang").alias("fixture")).agg(F.round(F.avg(F.when(F.col("w") > 100, 1.0).otherwise(0.5)), 4).alias("mrr"), F.count_if(F.col("w") < 20).alias("misses"), F.count_if(F.col("w") < 60).alias("nav_words"), F.sum("w").alias("total_ms"), F.count("*").alias("chunks"))
    return evaluate.guards(made(d), made(d.where("w >= 50")))


NAMES = (doc_words, doc_cleaned, doc_structure, doc_sentences, doc_scores, doc_adaptive, doc_titled, doc_prompts, extraction_diagnostics, keyword_search, keyword_search_agent, page_lookup, page_list, chunk_words, chunk_markdown, chunk_semantic, semantic_breaks, vector_rows, vector_topk, rank_of_match, mrr, rank_of_match_all, mrr_all, span_first_document, bm25, hybrid_retrieval, throttle_delays, response_means, spread_sample, source_counts, conversation_chunks, robots_sitemaps, robots_allowed, replies, regression_guards)
QUERIES = {f.__name__: f for f in NAMES}

# --- SQL

EMB = "(SELECT vec_id AS id, embedding AS vector, label FROM embeddings)"
PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' \n\t\r')), lambda p: p <> '')".replace(r"' \n\t\r'", "chr(32) || chr(10) || chr(9) || chr(13)")
WS = "chr(32) || chr(10) || chr(9) || chr(13)"
SCORE_PARTS = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, {WS})), lambda s: s <> '')"
TERMS = ASKED.split()


def _hits(hay: str) -> str:
    return " + ".join(f"contains({hay}, '{w}')::INT" for w in TERMS)


def _snippet(before: int, after: int) -> str:
    at = "list_min(list_filter([" + ", ".join(f"instr(lower(text), '{w}')" for w in TERMS) + "], lambda p: p > 0))"
    lo, hi = f"greatest({at} - 1 - {before}, 0)", f"least({at} - 1 + {after}, length(text))"
    return f"""CASE WHEN {at} IS NOT NULL THEN CASE WHEN {lo} > 0 THEN '...' ELSE '' END || trim(substring(text, {lo} + 1, {hi} - {lo}), {WS}) || CASE WHEN {hi} < length(text) THEN '...' ELSE '' END
      ELSE trim(left(text, 200), {WS}) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END END"""


COSINE = "round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6)"
RANKS = f"""SELECT query_id, query_label, min(rank) FILTER (label = query_label) AS rank FROM (
  SELECT b.id AS query_id, b.label AS query_label, a.label, row_number() OVER (PARTITION BY b.id ORDER BY {COSINE} DESC, a.id) AS rank
  FROM {EMB} AS a, (SELECT * FROM {EMB} AS e WHERE id % 100 = 0) AS b WHERE a.id <> b.id) AS r GROUP BY 1, 2"""
TF = ", ".join(f"len(list_filter(ws, lambda w: w = '{w}'))::BIGINT AS tf{i}" for i, w in enumerate(TERMS))
BM25 = f"""WITH d AS (SELECT id, ws, len(ws) AS n FROM (SELECT id, {S.words('lower(text)')} AS ws FROM src WHERE text IS NOT NULL) AS w), c AS (SELECT id, n, {TF} FROM d),
  s AS (SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM c)
  SELECT id, {' + '.join(f'ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * n / mean))' for i in range(len(TERMS)))} AS bm25 FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))}"""
PROBE = "[" + ", ".join(f"{(-1) ** i * (i % 7) / 7!r}::DOUBLE" for i in range(64)) + "]"
GUARD = "SELECT lang AS fixture, round(avg(CASE WHEN w > 100 THEN 1.0::DOUBLE ELSE 0.5 END), 4) AS mrr, count(*) FILTER (w < 20) AS misses, count(*) FILTER (w < 60) AS nav_words, sum(w)::BIGINT AS total_ms, count(*) AS chunks FROM d {} GROUP BY lang"
# Paragraphs are joined while they fit in 60 words, those that are longer by themselves are split; what follows the first piece carries the heading.
MARKDOWN_CHUNKS = f"""WITH RECURSIVE m AS (SELECT page_id, {S.title('html')} AS title, {web.MARKDOWN} AS text FROM pages),
  p AS (SELECT page_id, title, {S.n_words('text')} AS all_words, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM m),
  heads AS (SELECT *, list_position(list_transform(ps, lambda x: starts_with(x, '# ')), true) AS k FROM p),
  cut AS (SELECT page_id, title, 1 AS part, ps[:k - 1] AS ps, '' AS head FROM heads WHERE all_words > 60 AND k > 1
    UNION ALL SELECT page_id, title, 2, ps[k:], ps[k] FROM heads WHERE all_words > 60 AND k > 0 UNION ALL SELECT page_id, title, 2, ps, '' FROM heads WHERE all_words > 60 AND k IS NULL),
  whole AS (SELECT *, {S.n_words("array_to_string(ps, ' ')")} <= 60 AS fits FROM cut),
  walk AS (SELECT page_id, title, part, head, ps, fits, 1 AS i, 0 AS piece, ps[1] AS held FROM whole
    UNION ALL SELECT page_id, title, part, head, ps, fits, i + 1, piece + (NOT joins)::INT, CASE WHEN joins THEN held || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END
    FROM (SELECT *, fits OR {S.n_words('held')} + {S.n_words('ps[i + 1]')} <= 60 AS joins FROM walk WHERE i < len(ps)) AS w),
  packed AS (SELECT page_id, title, part, head, piece, CASE WHEN piece > 0 AND head <> '' AND NOT starts_with(held, '#') THEN head || chr(10) || chr(10) || held ELSE held END AS text FROM walk QUALIFY i = max(i) OVER (PARTITION BY page_id, part, piece)),
  split AS ({web.word_chunks('SELECT page_id, title, part, head, piece, text FROM packed', 'page_id, title, part, head, piece', 60, 10)}),
  named AS (SELECT page_id, title, part, piece, idx, CASE WHEN idx > 0 AND starts_with(text0, '# ') AND NOT starts_with(chunk, '#') THEN head0 || chr(10) || chr(10) || chunk ELSE chunk END AS chunk
    FROM (SELECT split.*, packed.text AS text0, split_part(packed.text, chr(10), 1) AS head0 FROM split JOIN packed USING (page_id, part, piece)) AS j
    UNION ALL SELECT page_id, title, 0, 0, 0, text FROM p WHERE all_words BETWEEN 1 AND 60)
  SELECT page_id, CASE WHEN title = '' OR starts_with(chunk, '# ') THEN '' ELSE 'Section: ' || title || chr(10) || chr(10) END || chunk AS text, (row_number() OVER (PARTITION BY page_id ORDER BY part, piece, idx) - 1)::INT AS "index", (count(*) OVER (PARTITION BY page_id))::INT AS total FROM named"""
HEAD_PROMPT = "Read the page and answer with one JSON object and nothing else. Its keys are exactly: [\"company_name\", \"pricing\"]. Give null for what the page doesn''t say."

ORACLE = {
    "doc_words": f"SELECT doc_id, {S.n_words('text')} AS words, text <> '' AND {S.n_words('text')} >= 20 AS kept, sha1(text) AS hash FROM documents",
    "doc_cleaned": f"""SELECT doc_id, sha1(trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, {WS})), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), {WS})) AS compact,
      sha1(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\\n\\z', ''), chr(10)), lambda x: rtrim(x, {WS})), chr(10))) AS cleaned,
      sha1(regexp_replace(text, '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g')) AS unlinked FROM documents""",
    "doc_structure": f"""SELECT doc_id, trim(substring(list_filter(list_transform(string_split(text, chr(10))[1:200], lambda x: trim(x, {WS})), lambda x: starts_with(x, '# '))[1], 3), {WS}) AS h1,
      sha1(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '' AND NOT regexp_matches(x, '^(!\\[|```|[#|>*-])'))[1]) AS lead,
      len({PARTS})::BIGINT AS paragraphs, sha1(array_to_string({PARTS}, chr(30))) AS paragraph_sha1, CASE WHEN regexp_matches(text, '^#{{1,6}}\\s') THEN trim(split_part(text, chr(10), 1), {WS}) ELSE '' END AS heading, array_to_string(regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2), ' ') AS images FROM documents""",
    "doc_sentences": f"""SELECT doc_id, len(own)::BIGINT AS sentences, sha1(array_to_string(own, chr(30))) AS sentence_sha1 FROM (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform({PARTS}, lambda p: regexp_replace(p, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')), chr(1)), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '') AS own FROM documents) AS d""",
    "doc_scores": f"""SELECT doc_id, round(CASE WHEN n > 0 THEN n * 0.3::DOUBLE + (1 - links / n) * 0.3::DOUBLE + least(coalesce(list_sum(list_transform(own, lambda s: {S.n_words('s')})), 0) / greatest(len(own), 1) / 20, 1.0) * 0.2::DOUBLE
      + (regexp_matches(text, '(?m)^#{{1,6}}\\s+')::INT + contains(text, chr(10) || chr(10))::INT) * 0.1::DOUBLE ELSE 0.0 END, 6) AS score
      FROM (SELECT doc_id, text, {S.n_words('text')} AS n, len(regexp_extract_all(text, '\\[.*?\\]\\(.*?\\)')) AS links, {SCORE_PARTS} AS own FROM documents) AS d""",
    "doc_adaptive": f"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS i FROM documents),
      f AS (SELECT *, starts_with(trim(x, {WS}), '```') AS fence, sum(starts_with(trim(x, {WS}), '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
      c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT fence AND k % 2 = 1) AS code FROM f GROUP BY doc_id),
      m AS (SELECT d.doc_id, n, code, greatest({S.n_words('text')}, 1) AS w, len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+')) AS h, len(regexp_extract_all(text, '(?m)^\\s*(?:[-*]|\\d+\\.)\\s')) AS items FROM documents AS d JOIN c ON c.doc_id = d.doc_id)
      SELECT doc_id, greatest(trunc((1.25::DOUBLE - (least(code / n * 2.0, 1.0) * 0.4::DOUBLE + least(CASE WHEN w >= 100 THEN h / (w / 100) ELSE h END / 2.0, 1.0) * 0.3::DOUBLE + least(items / n * 1.5, 1.0) * 0.3::DOUBLE) * 0.6::DOUBLE) * 400)::BIGINT, 100) AS max_words FROM m""",
    "doc_titled": f"""SELECT doc_id, sha1(CASE WHEN starts_with(ltrim(text, {WS}), '# ') THEN text ELSE '# Document ' || doc_id || chr(10) || chr(10) || text END) AS titled,
      CASE WHEN starts_with(ltrim(text, {WS}), '# ') THEN '' ELSE 'Section: ' || source || ' > ' || lang || chr(10) || chr(10) END AS breadcrumb FROM documents""",
    "doc_prompts": f"""SELECT doc_id, sha1('{HEAD_PROMPT}' || chr(10) || chr(10) || 'Address: ' || source || chr(10) || chr(10) || '=== page ===' || chr(10) || left(text, 8000)) AS prompt FROM documents""",
    "extraction_diagnostics": f"""SELECT source, count(*) AS pages, sum({S.n_words('text')})::BIGINT AS total_words, sum(len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+')))::BIGINT AS headings, sum(len(regexp_extract_all(text, '```')) // 2)::BIGINT AS fences,
      sum(len(regexp_extract_all(array_to_string(({S.words('text')})[1:100], ' '), '\\[[^\\]]*\\]\\([^)]*\\)')))::BIGINT AS nav_words, count(*) FILTER (contains(text, chr(10) || chr(10))) AS with_paragraphs, round(avg({S.n_words('text')}), 1) AS avg_words FROM documents GROUP BY source""",
    "keyword_search": f"""SELECT page_id, score, {_snippet(100, 100)} AS snippet FROM (SELECT page_id, content AS text, {_hits("lower(title || ' ' || content)")} AS score FROM ({web.ARTICLES}) AS a) AS s WHERE score > 0 ORDER BY score DESC, page_id LIMIT 10""",
    "keyword_search_agent": f"SELECT doc_id, score, {_snippet(100, 200)} AS snippet FROM (SELECT doc_id, text, {_hits('lower(text)')} AS score FROM documents) AS s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "page_lookup": "SELECT page_id, url FROM pages WHERE rtrim(lower(url), '/') = (SELECT rtrim(lower(max(url)), '/') FROM pages) ORDER BY page_id LIMIT 1",
    "page_list": f"SELECT url, title, {S.n_words('content')} AS words FROM ({web.ARTICLES}) AS a",
    "chunk_words": f"SELECT doc_id, idx AS chunk_index, total AS chunk_total, sha1(chunk) AS chunk FROM ({web.word_chunks('SELECT doc_id, text FROM documents', 'doc_id', 400, 50)}) AS c",
    "conversation_chunks": f"""SELECT conv_id, idx AS "index", total, chunk AS text FROM ({web.word_chunks('SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id', 'conv_id', 60, 10)}) AS c""",
    "vector_rows": f"""SELECT url, idx AS chunk_index, total AS chunk_total, sha1(CASE WHEN title = '' OR starts_with(chunk, '# ') THEN '' ELSE 'Section: ' || title || chr(10) || chr(10) END || chunk) AS chunk, 256 AS dims
      FROM ({web.word_chunks('SELECT url, title, text FROM (' + web.ORACLE['page_rows'] + ') AS p', 'url, title', 500, 50)}) AS c""",
    "chunk_markdown": MARKDOWN_CHUNKS,
    "semantic_breaks": f"""SELECT id, label, sum(fresh) OVER (PARTITION BY label ORDER BY id)::BIGINT AS run FROM (SELECT id, label, CASE WHEN coalesce(list_cosine_similarity(vector::DOUBLE[], lag(vector::DOUBLE[]) OVER (PARTITION BY label ORDER BY id)), 1.0) < 0 THEN 1 ELSE 0 END AS fresh FROM {EMB} AS e) AS f""",
    "vector_topk": f"SELECT id, similarity FROM (SELECT a.id, {COSINE} AS similarity FROM {EMB} AS a, (SELECT * FROM {EMB} AS e ORDER BY id LIMIT 1) AS b) AS s ORDER BY similarity DESC, id LIMIT 10",
    "rank_of_match": RANKS,
    "mrr": f"SELECT count(*) AS queries, round(avg(coalesce(round(1.0::DOUBLE / rank, 4), 0.0)), 4) AS mrr, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10, count(*) FILTER (rank IS NULL) AS misses FROM ({RANKS}) AS r",
    "span_first_document": "SELECT b.item_id, min(d.doc_id) AS first_doc FROM benchmark AS b LEFT JOIN documents AS d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id, b.text",
    "bm25": f"WITH src AS (SELECT doc_id AS id, text FROM documents), x AS ({BM25}) SELECT id AS doc_id, round(bm25, 6) AS bm25 FROM x",
    "hybrid_retrieval": f"""WITH src AS (SELECT d.doc_id AS id, d.text, e.vector FROM documents AS d JOIN {EMB} AS e ON e.id = d.doc_id), x AS ({BM25}),
      y AS (SELECT src.id, coalesce(x.bm25, 0) AS bm25, coalesce(list_cosine_similarity(src.vector::DOUBLE[], {PROBE}), 0) AS cosine FROM src LEFT JOIN x ON src.id = x.id WHERE src.text IS NOT NULL), z AS (SELECT *, min(bm25) OVER () AS bl, max(bm25) OVER () AS bh, min(cosine) OVER () AS cl, max(cosine) OVER () AS ch FROM y)
      SELECT id, round(0.7::DOUBLE * CASE WHEN ch > cl THEN (cosine - cl) / (ch - cl) ELSE 0 END + (1 - 0.7::DOUBLE) * CASE WHEN bh > bl THEN (bm25 - bl) / (bh - bl) ELSE 0 END, 6) AS score FROM z ORDER BY score DESC, id LIMIT 10""",
    "throttle_delays": """WITH RECURSIVE a AS (SELECT user_id, event_id, event_type = 'error' AS bad, value / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      w AS (SELECT user_id, event_id, bad, n, 0.0::DOUBLE AS active, 0::BIGINT AS backoff, []::DOUBLE[] AS times, s, 0 AS done FROM a WHERE n = 1),
      r AS (SELECT user_id, event_id, n, CASE WHEN bad THEN 1.0::DOUBLE ELSE CASE WHEN s > 0.5 THEN greatest(0.25, s / 2) ELSE 0.25 END END AS active, bad::BIGINT AS backoff, CASE WHEN bad THEN []::DOUBLE[] ELSE [s] END AS times FROM w
      UNION ALL SELECT x.user_id, x.event_id, x.n, CASE WHEN x.bad THEN greatest(1.0, 2 * x.active) WHEN x.nb = 0 AND list_avg(x.nt) > 0.5 THEN greatest(0.25, list_avg(x.nt) / 2) WHEN x.backoff > 0 AND x.nb = 0 THEN 0.25 ELSE x.active END, CASE WHEN x.bad THEN x.backoff + 1 ELSE x.nb END, CASE WHEN x.bad THEN x.times ELSE x.nt END
        FROM (SELECT a.user_id, a.event_id, a.bad, a.n, r.active, r.backoff, r.times, greatest(r.backoff - 1, 0) AS nb, list_append(r.times, a.s)[-10:] AS nt FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1) AS x)
      SELECT user_id, event_id, round(active + 1e-9, 6) AS delay FROM r""",
    "response_means": "SELECT event_id, round(avg(value / 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean_seconds FROM events",
    "spread_sample": "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, greatest(1, 20 // (SELECT count(DISTINCT source) FROM documents)) AS share FROM documents WHERE source IS NOT NULL) AS s ORDER BY (n > share)::INT, source, doc_id LIMIT 20",
    "source_counts": "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source",
    "robots_sitemaps": f"SELECT host, unnest(['https://' || host || '/sitemap.xml', 'https://' || host || '/news.xml']) AS sitemap FROM (SELECT DISTINCT {S.netloc('url')} AS host FROM pages) AS h",
    "robots_allowed": f"SELECT page_id, NOT starts_with({S.path('url')}, '/fr/') AS allowed FROM pages",
    "replies": "SELECT conv_id, turn, turn::BIGINT AS read, NULL::VARCHAR AS unread FROM conversations",
    "regression_guards": f"""WITH d AS (SELECT lang, {S.n_words('text')} AS w FROM documents), b AS ({GUARD.format('')}), c AS ({GUARD.format('WHERE w >= 50')}),
      j AS (SELECT b.*, coalesce(c.mrr, 0) AS m2, coalesce(c.misses, 0) AS x2, coalesce(c.nav_words, 0) AS n2, coalesce(c.total_ms, 0) AS t2, coalesce(c.chunks, 0) AS k2 FROM b LEFT JOIN c ON c.fixture = b.fixture)
      SELECT fixture, round(m2 - mrr, 6) AS mrr_gain, CASE WHEN round(m2 - mrr, 6) < -0.005 OR x2 > misses OR n2 > greatest(2, 2 * nav_words) OR t2 > 1.5 * total_ms OR k2 > 1.5 * chunks THEN 'REJECTED' WHEN round(m2 - mrr, 6) > 0.005 THEN 'ACCEPTED' ELSE 'NEUTRAL' END AS verdict FROM j""",
}
