"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret masking, mixing.

Each stage gets the documents that its predecessor kept, read again from the Parquet that was written, and
all but the last return the columns of ``documents``; the mix adds ``copies``, how often a document is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from serploom.llm import decontam, mixing, neardup, quality, secret_scan
from serploom.session import ensure_checkpoint_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.drop_near_duplicates(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secret values masked."""
    return secret_scan.mask_secrets(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", distinct_documents),
    ("benchmark_decontamination", clean_documents),
    ("secret_masking", masked_documents),
    ("source_mix", mixed_documents),
]

#: sketches, distances and sampling are no SQL; tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
