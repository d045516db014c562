"""Operators as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions import chunking, dom
from weftline.operators.pages import EXTRACTED
from weftline.sources.tables import small_batches


def register(spark: SparkSession) -> list[str]:
    """Adds weft_extract(html, url), weft_url(url), weft_strip_overlays(html) and the table
    function weft_chunks(text, max_words, overlap); returns their names."""

    @F.pandas_udf(EXTRACTED)
    def extract(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        names = ("title", "content", "links", "page_type", "description", "json_ld")
        return pd.DataFrame([dict.fromkeys(names) if h is None else dom.extracted(h, u) for h, u in zip(html, url)], columns=names)

    @F.pandas_udf("string")
    def url_of(url: pd.Series) -> pd.Series:
        return url.map(lambda u: u if u is None else dom.normalized(u))

    @F.pandas_udf("string")
    def strip(html: pd.Series) -> pd.Series:
        return html.map(lambda h: h if h is None else dom.without_overlays(h))

    @F.udtf(returnType="text string, index int, total int")
    class Chunks:
        def eval(self, text: str, most: int, overlap: int):
            yield from chunking.rows(chunking.by_words(text or "", most, overlap))

    small_batches(spark)
    for name, f in (("weft_extract", extract), ("weft_url", url_of), ("weft_strip_overlays", strip)):
        spark.udf.register(name, f)
    spark.udtf.register("weft_chunks", Chunks)
    return ["weft_extract", "weft_url", "weft_strip_overlays", "weft_chunks"]
