"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bpe, bytecnn, chat, guesses, lempelziv, minhash, mixing, recipes, repeats, runindex, simhash


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guesses.secrets(documents(spark, sf_dir))


def op2_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.duplicate_spans(spark, documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir))


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.duplicate_spans(spark, documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bytecnn.scored(docs, bytecnn.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.duplicates(spark, documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark, documents(spark, sf_dir))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_lempel_ziv": op2_lempel_ziv,
        "op3_bpe": op3_bpe,
        "op4_run_index": op4_run_index,
        "op5_quality": op5_quality,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_simhash": op7_simhash,
        "op8_chat": op8_chat,
        "op9_mixing": op9_mixing,
        "op10_minhash": op10_minhash,
        "pipeline": corpus_pipeline.run,
    }


OP6_SQL = """
SELECT doc_id, keep_id, n_copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS n_copies
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) AS d
) AS g WHERE doc_id <> keep_id
"""


def oracle_sql() -> dict[str, str]:
    spans = repeats.SQL.format(least=50)
    sql = {"op2_lempel_ziv": spans, "op4_run_index": spans, "op6_exact_dedup": OP6_SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
