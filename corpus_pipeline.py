"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that the one before it left, in the documents'
own columns, and its result is written to the shared folder and read again, so
a lost executor costs a stage's part and never the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, odd_sketch, packing, quality_rules, secrets
from tidemark.llm.common import discard, materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest doc_id stays."""
    return odd_sketch.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their targets."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix), ("packing", pack)]
#: SQL expresses neither the near-duplicate stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences made from the documents of sf_dir."""
    docs, written = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
