"""A training corpus from documents: quality, near-dedup, decontamination, mix, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages before the last
return the columns of documents. Rules, parameters and odd cases: the operators' docstrings.
Columns that documents have besides its own stay as they are, whatever their names; tables
without rows give no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, mixing, quality_rules, queries, simhash, token_binary
from lexloom.llm.common import small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts (fewer than 10 words) fail the base rules and go. Texts of any
    length are measured whole; repeated rows are judged each alone, so all stay or all go.
    """
    small_batches(spark)
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id.

    Null and empty texts have fingerprint zero and are one group. Rows that repeat an id count
    as one document. Rows without an id can't be told apart: all of them stay if one is in a
    group in which nothing has an id, else all go.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; so does everything where the benchmark is empty.
    Items of fewer than five words count if whole and exact. Repeated rows share their fate.
    """
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's epochs have them; a leaf's last one is cut to its tokens.

    Null and texts without a word have no tokens and go. Null languages and sources are leaves of
    their own. Repeated rows count each; ties in a leaf's order go by id, then length.
    """
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, as reading them back gives them.

    A null or empty text is the end id alone. Null ids come first; repeated ids have a row each.
    No rows give no file and no row. Columns beyond doc_id and text are not read.
    """
    small_batches(spark)
    return token_binary.write_and_read(docs, queries.word_bpe(), end_id=1, by_word=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_weights", mix),
    ("token_binary_output", token_files),
]

#: Suffix arrays, fingerprints and the tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
