"""The driver's queries over this folder's operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, language_id, license_scan, mixing, quality_rules, simhash, token_binary, token_counts, url_filter, warc
from lexloom.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_predict(_table(spark, sf_dir, "documents"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.write_and_read(_table(spark, sf_dir, "documents"), word_bpe(), end_id=1, by_word=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"), spans=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_token_binary": op4_token_binary,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL}
