"""Corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes what the one before it kept, whole, and is written and read again between stages. All but the last
return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import packing, quality_rules, secrets, simhash, substring
from feedloom.llm.common import staged
from feedloom.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that are found elsewhere too leave the text; what is left is joined by single spaces."""
    return substring.remove_passages(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", keep_one),
    ("substring_dedup", remove_passages),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Chains of similar documents, trained secret models and token packing are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None
