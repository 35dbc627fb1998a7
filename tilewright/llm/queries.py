"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontam, embeddings, licenses, linededup, quality, simhash, spm, substring, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(_table(spark, sf_dir, "documents"), spm.load())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.judged(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.judged(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.judged(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judged(_table(spark, sf_dir, "documents"))


_ALL = (op1_decontamination, op2_toxicity, op3_quality, op4_sentencepiece, op5_line_dedup, op6_url_filter, op7_substring_dedup, op8_embedding_dedup, op9_license_scan, op10_simhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: The others are held against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_decontamination": decontam.ORACLE_SQL,
    "op5_line_dedup": linededup.ORACLE_SQL,
    "op7_substring_dedup": substring.ORACLE_SQL,
    "op8_embedding_dedup": embeddings.ORACLE_SQL,
}
