"""The corpus pipeline: documents in, cleaned and tokenised documents out.

STAGES names the steps in order; each takes (spark, docs, sf_dir) and returns the
documents that stay, with their columns (the last adds the token columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontaminate, line_dedup, minhash_dedup, sentencepiece_fst, toxicity
from newsloom.session import drop_stored, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, calls toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document go, and documents of nothing else."""
    return line_dedup.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """token_ids, n_tokens and lossless are added."""
    return sentencepiece_fst.add_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("sentencepiece", tokenized),
]

#: Several stages have no SQL equivalent; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_stored(spark, before)
        before = path
    return docs
