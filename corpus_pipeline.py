"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, mixing, tokenization.

Every stage takes ``(spark, docs, sf_dir)``; each but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import bpe, exact, mixing, near, quality_rules
from lumenfold.llm.store import Tables
from lumenfold.session import prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and every certified rule of their language."""
    prepare(spark)
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then of smallest id."""
    prepare(spark)
    return exact.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of smallest id."""
    prepare(spark)
    return near.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, so ids repeat; a text is cut only where no whole one comes near its source's target."""
    prepare(spark)
    return mixing.mixed(docs, whole=True)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row's text, and digests of ids and of the text decoded from them."""
    prepare(spark)
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("bpe", tokens_stage)]

#: Sampling and models are not SQL: tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again as the next one's input."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir))
        tables.drop(before)
    return docs
