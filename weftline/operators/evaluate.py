"""Measuring extraction and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import chunking, text
from weftline.operators import enrich, pages, search
from weftline.sources import files

MRR_BAND, MOST_GROWTH = 0.005, 1.5


def diagnostics(df: DataFrame, content: str = "content", links: str | None = None) -> DataFrame:
    """df with n_words, n_chunks, n_headings, n_fences, has_paragraphs, nav_words (link
    references in the first hundred words) and n_links."""
    c = F.col(content)
    start = F.array_join(F.slice(text.words(c), 1, 100), " ")
    return (
        df.withColumn("n_words", text.word_count(c))
        .withColumn("n_chunks", F.size(chunking.chunks(c, markdown=F.lit(True))).cast("long"))
        .withColumn("n_headings", F.regexp_count(c, F.lit(r"(?m)^#{1,6}\s+")).cast("long"))
        .withColumn("n_fences", F.floor(F.regexp_count(c, F.lit("```")) / 2).cast("long"))
        .withColumn("has_paragraphs", F.contains(c, F.lit("\n\n")))
        .withColumn("nav_words", F.regexp_count(start, F.lit(r"\[[^\]]*\]\([^)]*\)")).cast("long"))
        .withColumn("n_links", (F.size(links) if links else F.lit(0)).cast("long"))
    )


def summary(d: DataFrame) -> DataFrame:
    """Totals and means, rounded to one place."""
    sums = [F.sum(c).alias(f"total_{c}") for c in ("n_words", "n_chunks", "n_headings", "n_fences", "nav_words", "n_links")]
    return d.agg(F.count("*").alias("pages"), *sums, F.round(F.avg("n_words"), 1).alias("avg_words"), F.round(F.avg("n_chunks"), 1).alias("avg_chunks"), F.count_if("has_paragraphs").alias("with_paragraphs"))


def compare(df: DataFrame, extractors: dict[str, Column]) -> DataFrame:
    """metric with a column for each extractor."""
    out = None
    for name, column in extractors.items():
        s = summary(diagnostics(df.withColumn("content", column)))
        long = s.select(F.lit(name).alias("extractor"), F.explode(F.create_map(*[x for c in s.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
        out = long if out is None else out.unionByName(long)
    return out.groupBy("metric").pivot("extractor", list(extractors)).agg(F.first("value"))


def ranks(cases: DataFrame, most: int = 128, embed=enrich.hashing_embedder, form: str = "markdown") -> DataFrame:
    """(fixture, query, answer_span, rank) of the first chunk that has the answer among its
    page's chunks by likeness to the query; null if no chunk has it."""
    page = cases.select("fixture", "html").distinct().select("fixture", pages.extract(F.col("html"), form=form).alias("x"))
    c = page.select("fixture", F.posexplode(chunking.chunks(F.col("x.content"), F.col("x.title"), F.lit(True), most, min(50, most - 1), adaptive=True)).alias("index", "c"))
    c = c.select("fixture", "index", F.col("c.text").alias("chunk"), enrich.embedded(F.col("c.text"), embed).alias("chunk_vector"))
    q = cases.select("fixture", "query", "answer_span").distinct()
    right = search.first_containing(q, c, "answer_span", "chunk", "index", ["fixture"])
    scored = q.withColumn("query_vector", enrich.embedded(F.col("query"), embed)).join(c, "fixture").withColumn("similarity", search.dot(F.col("query_vector"), F.col("chunk_vector")))
    placed = F.struct(-F.col("similarity"), F.col("index"))
    both = scored.select("fixture", "query", "answer_span", "index", placed.alias("p"))
    own = both.join(right.withColumnRenamed("first_index", "index"), ["fixture", "query", "answer_span", "index"]).select("fixture", "query", "answer_span", F.col("p").alias("own"))
    rank = both.join(own, ["fixture", "query", "answer_span"]).groupBy("fixture", "query", "answer_span").agg((F.count_if(F.col("p") < F.col("own")) + 1).alias("rank"))
    return q.join(rank, ["fixture", "query", "answer_span"], "left")


def guards(baseline: DataFrame, candidate: DataFrame, key: str = "fixture") -> DataFrame:
    """Verdict on a change, one row a fixture of the baseline: REJECTED if the mean reciprocal
    rank falls by more than 0.005, or misses grow, navigation words exceed twice the old ones
    (and 2), or time or chunks 1.5 times; ACCEPTED if the rank gains more than 0.005; else
    NEUTRAL. What the candidate lacks counts as 0."""
    names = ("mrr", "misses", "nav_words", "total_ms", "chunks")
    b = baseline.select(key, *(F.col(n).alias(f"b_{n}") for n in names))
    c = candidate.select(key, *(F.col(n).alias(f"c_{n}") for n in names))
    j = b.join(c, key, "left").fillna(0, [f"{s}_{n}" for s in "bc" for n in names])
    gain = F.round(F.col("c_mrr") - F.col("b_mrr"), 6)
    worse = (gain < -MRR_BAND) | (F.col("c_misses") > F.col("b_misses")) | (F.col("c_nav_words") > F.greatest(F.lit(2), 2 * F.col("b_nav_words"))) | ((F.col("b_total_ms") > 0) & (F.col("c_total_ms") > MOST_GROWTH * F.col("b_total_ms"))) | ((F.col("b_chunks") > 0) & (F.col("c_chunks") > MOST_GROWTH * F.col("b_chunks")))
    return j.select(key, gain.alias("mrr_gain"), F.when(worse, "REJECTED").when(gain > MRR_BAND, "ACCEPTED").otherwise("NEUTRAL").alias("verdict"))


def measures(cases: DataFrame, embed=enrich.hashing_embedder, most: int = 128, form: str = "markdown") -> DataFrame:
    """What guards compare, a row a fixture: mrr, misses, nav_words, total_ms (0, for tasks
    overlap) and chunks, with one setting of chunk size and form."""
    found = search.rank_metrics(ranks(cases, most, embed, form), by="fixture").select("fixture", "mrr", "misses")
    page = cases.select("fixture", "html").distinct().select("fixture", pages.extract(F.col("html"), form=form)["content"].alias("content"))
    d = diagnostics(page).groupBy("fixture").agg(F.sum("nav_words").alias("nav_words"), F.sum("n_chunks").alias("chunks"))
    return found.join(d, "fixture").withColumn("total_ms", F.lit(0).cast("long"))


def experiments(spark, cases: DataFrame, settings: dict[str, dict], at: str, embed=enrich.hashing_embedder) -> list[dict]:
    """Tries settings (arguments of `measures`) one after the other against the baseline in
    at/baseline, which the first run of an empty folder makes from the defaults. A setting is
    accepted if some fixture's verdict is ACCEPTED and none is REJECTED, and is then the new
    baseline. Each trial is a line of at/history; they are returned, too."""
    base = f"{at}/baseline"
    if files.read_current(spark, base) is None:
        files.write_current(spark, measures(cases, embed), base)
    trials = []
    for name, given in settings.items():
        found = measures(cases, embed, **given)
        verdicts = [r.asDict() for r in guards(files.read_current(spark, base), found).orderBy("fixture").collect()]
        kinds = {v["verdict"] for v in verdicts}
        accepted = "ACCEPTED" in kinds and "REJECTED" not in kinds
        if accepted:
            files.write_current(spark, found, base)
        trials.append({"name": name, "settings": given, "accepted": accepted, "verdicts": verdicts})
        files.append_log(spark, trials[-1:], f"{at}/history")
    return trials
