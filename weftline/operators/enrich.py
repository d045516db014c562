"""Embeddings and fields from language models, through injected clients.

An embedder is a function from a list of texts to a list of vectors, a client one from a
prompt to a reply. Both are shipped to the workers; make connections inside them.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import chunking, text
from weftline.operators import search
from weftline.sources.tables import small_batches

Embedder = Callable[[list[str]], list[list[float]]]
Complete = Callable[[str], str]
FENCE = re.compile(r"`{3}(?:json)?\s*(.*?)`{3}", re.S)
TEXT_CHARS, SAMPLE_CHARS = 8000, 4000


def hashing_embedder(texts: list[str], dims: int = 256) -> list[list[float]]:
    """Unit vectors of hashed words: deterministic, needs no model. A text without words has zeros."""
    out = []
    for t in texts:
        v = [0.0] * dims
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dims] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        out.append([x / size for x in v] if size else v)
    return out


def embedded(column: Column, embed: Embedder = hashing_embedder, batch: int = 64, pause: float = 0.0) -> Column:
    """array<float> of each text, asked for in batches with a pause between; null for null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first = True
        for s in parts:
            out: list = [None] * len(s)
            some = [i for i, t in enumerate(s) if t is not None]
            for lo in range(0, len(some), batch):
                if pause and not first:
                    time.sleep(pause)
                first = False
                own = some[lo : lo + batch]
                for i, v in zip(own, embed([s.iloc[i] for i in own])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    small_batches()
    return run(column)


def chunk_rows(pages: DataFrame, most: int = 400, overlap: int = 50) -> DataFrame:
    """Rows for a vector table, without vectors: url, title, chunk_text, chunk_index,
    chunk_total, metadata<source_file>. Markdown pages are split along their headings with
    sizes by density, others by words; pages without text have no rows."""
    md = chunking.is_markdown(F.col("path"), F.col("text"))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
    plain = pages.where(~md).select("url", "title", "path", F.explode(chunking.chunks(F.col("text"), most=most, overlap=overlap)).alias("c"))
    marked = pages.where(md).select("url", "title", "path", F.explode(chunking.chunks(F.col("text"), title, F.lit(True), most, overlap, adaptive=True)).alias("c"))
    both = plain.unionByName(marked)
    return both.select("url", "title", F.col("c.text").alias("chunk_text"), F.col("c.index").alias("chunk_index"), F.col("c.total").alias("chunk_total"), F.struct(F.col("path").alias("source_file")).alias("metadata"))


def vector_rows(pages: DataFrame, embed: Embedder = hashing_embedder, **options) -> DataFrame:
    return chunk_rows(pages, **options).withColumn("embedding", embedded(F.col("chunk_text"), embed))


def insert(rows: DataFrame, put: Callable[[list[dict]], None], batch: int = 50, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """Gives rows in batches to a writer, asked again with doubling pauses; the last error
    ends the job. The result has the number of rows each task wrote. A repeated task writes
    its batches again: make the writer idempotent."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for df in parts:
            own = df.to_dict("records")
            for lo in range(0, len(own), batch):
                for n in range(tries):
                    try:
                        put(own[lo : lo + batch])
                        break
                    except Exception:
                        if n == tries - 1:
                            raise
                        time.sleep(pause * 2**n)
                done += len(own[lo : lo + batch])
        yield pd.DataFrame({"written": [done]})

    small_batches(rows.sparkSession)
    return rows.mapInPandas(run, "written long")


def parsed_reply(reply: str | None) -> dict | None:
    """The JSON object of a reply, out of its first fence if it has one."""
    m = FENCE.search(reply or "")
    try:
        found = json.loads((m[1] if m else reply or "").strip())
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def field_prompt(body: Column, url: Column, fields: list[str]) -> Column:
    """What a model is asked about a page, of whose text it sees the first 8000 characters."""
    head = "Read the page and answer with one JSON object and nothing else. Its keys are exactly: " + json.dumps(fields) + ". Give null for what the page doesn't say.\n\nAddress: "
    return F.concat(F.lit(head), F.coalesce(url, F.lit("")), F.lit("\n\n=== page ===\n"), F.substring(F.coalesce(body, F.lit("")), 1, TEXT_CHARS))


def extract_fields(pages: DataFrame, fields: list[str], complete: Complete, model: str = "", pause: float = 0.0) -> DataFrame:
    """Page columns with fields (map of names to values, null where not found), extracted_by
    and extraction_note. Asked-for names only; a reply that can't be read gives nulls."""
    small_batches(pages.sparkSession)
    prompts = pages.withColumn("weft_prompt", field_prompt(F.col("text"), F.col("url"), fields))

    @F.pandas_udf("array<string>")
    def ask(asked: pd.Series) -> pd.Series:
        out = []
        for p in asked:
            if pause:
                time.sleep(pause)
            found = parsed_reply(complete(p)) or {}
            out.append([None if found.get(f) is None else found[f] if isinstance(found[f], str) else json.dumps(found[f], ensure_ascii=False) for f in fields])
        return pd.Series(out)

    values = prompts.withColumn("weft_values", ask("weft_prompt"))
    names = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
    keep = [c for c in ("url", "title", "crawled_at", "citation", "_source") if c in pages.columns]
    return values.select(*keep, F.map_from_arrays(names, "weft_values").alias("fields"), F.lit(model).alias("extracted_by"), F.lit("Values come from a language model; check them against the page.").alias("extraction_note"))


def discovery_prompt(sample: list[tuple[str, str]], sources: int, goal: str = "") -> str:
    parts = ["Here are pages of a crawl. Name 5 to 15 fields (lower_case_names) worth extracting from pages like these, the most important first. Answer with a JSON object whose only key is fields, an array of names."]
    if goal:
        parts.append(f"What it is for: {goal}")
    if sources > 1:
        parts.append("The pages are from several sites: choose fields that can be compared between them.")
    parts += [f"=== page {i}: {url} ===\n{body[:SAMPLE_CHARS]}" for i, (url, body) in enumerate(sample, 1)]
    return "\n\n".join(parts)


def discover_fields(pages: DataFrame, complete: Complete, sample: int = 3, goal: str = "") -> list[str]:
    """Field names that a model suggests after reading a sample spread over the sources; none
    if its reply can't be read."""
    own = pages if "_source" in pages.columns else pages.withColumn("_source", F.lit("default"))
    rows = search.spread_sample(own.select("_source", "url", "text"), sample).collect()
    found = parsed_reply(complete(discovery_prompt([(r["url"] or "", r["text"] or "") for r in rows], own.select("_source").distinct().count(), goal)))
    return [str(f) for f in (found or {}).get("fields", [])]


def extract_all(pages: DataFrame, complete: Complete, fields: str | list[str] = "", **options) -> DataFrame:
    """extract_fields with names from a list or a comma-separated string; without any, with
    the names that discover_fields finds."""
    names = list(filter(None, map(str.strip, fields.split(",")))) if isinstance(fields, str) else list(fields)
    return extract_fields(pages, names or discover_fields(pages, complete), complete, **options)


def merged(extracted: DataFrame, names: list[str]) -> DataFrame:
    """Rows of extract_fields with a column for each name in place of the map. A name that a
    column of the page has already gets field_ before it, so that nothing is overwritten."""
    taken = {c.lower() for c in extracted.columns if c != "fields"}
    columns = [F.col("fields")[n].alias(f"field_{n}" if n.lower() in taken else n) for n in dict.fromkeys(names)]
    return extracted.select(*(c for c in extracted.columns if c != "fields"), *columns)


def semantic_breaks(sentences: DataFrame, key: str = "doc_id", index: str = "index", vector: str = "vector", threshold: float = 0.5) -> DataFrame:
    """Sentences with run, the number of their chunk: a new one begins where the similarity to
    the sentence before is under the threshold. Windows by document alone."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(index)
    alike = search.cosine(F.col(vector), F.lag(vector).over(w))
    return sentences.withColumn("fresh", F.when(F.coalesce(alike, F.lit(1.0)) < threshold, 1).otherwise(0)).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def json_of_reply(reply: Column) -> Column:
    return text.fenced_json(reply)
