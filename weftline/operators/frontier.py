"""The crawl frontier: which addresses come next, and in what order."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text, urls
from weftline.sources.tables import dropped, kept


def locale_counts(df: DataFrame, url: str = "url") -> DataFrame:
    """(locale, n)."""
    return df.select(urls.locale_segment(F.col(url)).alias("locale")).where("locale is not null").groupBy("locale").agg(F.count("*").alias("n"))


def confirmed_locales(df: DataFrame, url: str = "url", least_variants: int = 2, least_urls: int = 3) -> DataFrame:
    """The locales with enough URLs, if there are enough of them. At most a few hundred
    locales exist, so their counts fit one partition."""
    often = locale_counts(df, url).where(F.col("n") >= least_urls)
    return often.withColumn("k", F.count("*").over(Window.partitionBy(F.lit(1)))).where(F.col("k") >= least_variants).drop("k")


def site_profile(df: DataFrame, url: str = "url", primary: str = "en") -> DataFrame:
    """One row: sample_size, locale_counts (map), confirmed_locales, primary_language,
    i18n_non_primary, has_i18n_variants."""
    arrays = lambda d: d.agg(F.array_sort(F.collect_list(F.struct("locale", "n"))).alias("x"))
    size = df.agg(F.count("*").alias("sample_size"))
    counts = arrays(locale_counts(df, url)).select(F.map_from_entries("x").alias("locale_counts"))
    sure = arrays(confirmed_locales(df, url)).select(F.col("x.locale").alias("confirmed_locales"))
    base = urls.language(F.lit(primary))
    foreign = F.filter("confirmed_locales", lambda c: urls.language(c) != base)
    return size.crossJoin(counts).crossJoin(sure).select("*", F.lit(primary).alias("primary_language"), foreign.alias("i18n_non_primary"), (F.size(foreign) > 0).alias("has_i18n_variants"))


def section_sizes(df: DataFrame, url: str = "url") -> DataFrame:
    return df.groupBy(urls.section(F.col(url)).alias("pattern")).agg(F.count("*").alias("pattern_cluster_size"))


def smart_sample(df: DataFrame, url: str = "url", threshold: int = 20, sample: int = 5) -> DataFrame:
    """The URLs of small sections and, of sections over the threshold, those of least hash:
    all columns with pattern, pattern_cluster_size and is_sample. A section's size comes from
    a map-side aggregate, and its sample from a bounded one, so a hot section isn't sorted."""
    own = df.withColumn("pattern", urls.section(F.col(url)))
    sizes = section_sizes(df, url)
    sized = own.join(sizes, "pattern").withColumn("is_sample", F.col("pattern_cluster_size") > threshold)
    large = sized.where("is_sample").withColumn("weft_h", F.sha1(F.col(url).cast("binary"))).withColumn("weft_part", F.pmod(F.xxhash64(url), F.lit(64)))
    for keys in (["pattern", "weft_part"], ["pattern"]):  # first within parts, then over the few that remain
        w = Window.partitionBy(*keys).orderBy("weft_h", url)
        large = large.withColumn("weft_n", F.row_number().over(w)).where(F.col("weft_n") <= sample).drop("weft_n")
    return sized.where("not is_sample").unionByName(large.drop("weft_h", "weft_part"))


def yields(pages: DataFrame, url: str = "url", words: Column | None = None) -> DataFrame:
    """(segment, total_words, pages, avg_words) of saved pages."""
    n = text.word_count(F.col("text")) if words is None else words
    return pages.groupBy(urls.first_segment(F.col(url)).alias("segment")).agg(F.sum(n).alias("total_words"), F.count("*").alias("pages")).withColumn("avg_words", F.round(F.col("total_words") / F.col("pages"), 1))


def link_scores(candidates: DataFrame, stats: DataFrame, url: str = "url") -> DataFrame:
    """candidates with their expected yield as score."""
    averages = stats.select("segment", (F.col("total_words") / F.col("pages")).alias("weft_avg"))
    own = candidates.withColumn("segment", urls.first_segment(F.col(url))).join(averages, "segment", "left")
    return own.withColumn("score", urls.yield_score(F.col(url), F.col("weft_avg"))).drop("segment", "weft_avg")


def candidates(links: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Links not seen yet."""
    return links.join(seen.select(F.col("url").alias("weft_seen")), links[url] == F.col("weft_seen"), "left_anti")


def placed(links: DataFrame, url: str = "url", seed: str | None = None, score: str | None = None) -> DataFrame:
    """band and place of each link: by score in front of the queue; else, with a seed, those
    that share half of its path in front and the rest behind; else all behind."""
    if score:
        return links.withColumn("band", F.lit(0)).withColumn("place", -F.col(score))
    if seed:
        near = urls.path_priority(F.col(url), F.lit(seed)) >= 0.5
        return links.withColumn("band", F.when(near, 0).otherwise(2)).withColumn("place", F.lit(0.0))
    return links.withColumn("band", F.lit(2)).withColumn("place", F.lit(0.0))


def batch(frontier: DataFrame, size: int, saved: int = 0, most: int = 0, order: tuple = ("band", "place", "url")) -> DataFrame:
    """The next rows of the queue, no more than the page budget leaves (0: no budget)."""
    return frontier.orderBy(*order).limit(max(0, min(size, most - saved) if most else size))


def seeds(df: DataFrame, base: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), subdomains: bool = False, i18n: bool = False) -> DataFrame:
    """Normalised, in scope, not excluded, distinct."""
    own = df.select(urls.normalized(F.col("url")).alias("url")).where(urls.in_scope(F.col("url"), urls.netloc(F.lit(base)), subdomains))
    return own.where(~urls.path_excluded(F.col("url"), include, exclude, (base,), i18n)).distinct()


def reached(spark, start: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, depth) of all that breadth-first link following from start finds, to the last
    layer. Each round joins only the last layer with the edges, and is written to the shared
    folder, which cuts the lineage. Layers are merged by sixteens, so that no round reads
    more than some dozen tables and a page is rewritten a logarithmic number of times."""
    layer = kept(spark, start.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "layer")
    done: list[list[DataFrame]] = [[layer]]  # tables of one layer, of sixteen, of 256, ...
    together = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    depth = 0
    while not layer.isEmpty():
        depth += 1
        seen = together([t for level in done for t in level])
        nxt = layer.join(edges, layer["url"] == edges["src"]).select(F.col("dst").alias("url")).where("url is not null").distinct()
        layer = kept(spark, nxt.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "layer")
        done[0].append(layer)
        for k in range(len(done)):
            if len(done[k]) > 16:  # the last layer stays, it is joined next
                whole = kept(spark, together(done[k][:16]), "layers")
                dropped(spark, *done[k][:16])
                done[k] = done[k][16:]
                done += [[]] if k + 1 == len(done) else []
                done[k + 1].append(whole)
    return together([t for level in done for t in level])


def site_directories(df: DataFrame, url: str = "seed") -> DataFrame:
    """Folder of each seed: its host, and its path too where another seed has that host."""
    host = urls.site_directory(F.col(url))
    tail = F.regexp_replace(urls.stripped_path(F.col(url)), "[^A-Za-z0-9._-]+", "_")
    shared = F.count("*").over(Window.partitionBy(host)) > 1
    return df.withColumn("directory", F.concat(host, F.when(shared & (tail != ""), F.concat(F.lit("_"), tail)).otherwise("")))
