"""Training-corpus pipeline: quality filter, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Rows with a null text end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, bytecnn, mixing, recipes, simhash
from weftline.llm.plumbing import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte CNN, fitted to the labels, does not reject.

    Rows with a null text are rejected, an empty text is scored like any other, and a very
    long one over all its chunks. Repeated rows share their fate. Null cells elsewhere,
    ties and other columns play no part; columns pass through whatever their names.
    An empty table, or one without labels, gives back what it was given but null texts.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return bytecnn.good_documents(docs, bytecnn.fitted(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, byte for byte, the one with the least doc_id.

    Rows with a null doc_id or text are kept. Empty texts equal one another. Of rows that
    repeat doc_id and text one stays. A very long text is compared whole, as a long recipe
    of chunks. Columns pass through whatever their names; an empty table stays empty.
    """
    return recipes.without_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id.

    Rows with a null doc_id, or without a word, are kept. Rows that share a doc_id share
    their fate. A very long text has one fingerprint of all its words. Ties can't occur:
    groups are components, and their least doc_id is unique. Columns pass through whatever
    their names; an empty table stays empty.
    """
    return simhash.one_of_each_group(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights of sources and of languages, a row for each use.

    The targets flatten both: each has the corpus's tokens to the power 0.5, and both have
    the whole budget, so large sources and languages lose documents and small ones repeat
    theirs, up to four times. A null source or language is one of its own, named ''. Rows
    with a null or empty text are not chosen. A very long text is chosen or left whole.
    Rows that repeat doc_id and text share their fate; a null doc_id is hashed like any
    value. Columns pass through whatever their names; an empty table stays empty.
    """
    return mixing.mixed_documents(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang with the tokens of the text, their number and whether they decode to it.

    Every row has its result, repeated ones too; null cells of the kept columns stay null, a
    null text would have null tokens, an empty one none. A very long text is one list. An
    empty table gives no rows.
    """
    return bpe.encoded(docs, keep=("doc_id", "source", "lang"))


STAGES = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("bpe", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(spark, docs, "stage-" + name.replace(" ", "-"))
    return docs
