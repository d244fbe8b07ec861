"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, langid, licenses, negatives, packing, quality, search, simhash, suffix_dedup, toxicity, warc, winnowing
from .common import documents, labels


def tokenizer_path() -> str:
    """The public tokenizer that the contracts name; only its path is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(documents(spark, sf_dir))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op11_negatives": op11_negatives,
    "op12_warc": op12_warc,
    "op13_search": op13_search,
    "op10_winnowing": op10_winnowing,
    "op2_licenses": op2_licenses,
    "op1_packing": op1_packing,
    "op4_quality": op4_quality,
    "op3_toxicity": op3_toxicity,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_langid": op7_langid,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
}

ORACLE_SQL = {
    "op11_negatives": negatives.oracle_sql(),
    "op12_warc": warc.oracle_sql(),
    "op13_search": search.oracle_sql(),
    "op2_licenses": licenses.oracle_sql(),
    "op9_exact_dedup": """
        WITH n AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
}
