"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder of the session and rereads it as the next stage's docs, so every stage works on all
that its predecessor kept and a lost executor costs at most the running stage. All stages but the
last return the columns of `documents`; the last adds size, source_size, target and taken (the words
that the mix takes of the document, repeats counted) and leaves out documents that are not taken.

Nulls, empty texts, repeated rows and empty tables: a document without words fails the quality rules;
of repeated rows the near-duplicate stage keeps one; empty tables stay empty through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwire.llm import decontaminate, mixing, quality_rules, secret_scan, simhash
from tripwire.llm.common import table
from tripwire.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every group linked by SimHash: 3-word shingles, 2 bits."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5% lie inside 13-word windows of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted anew."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken."""
    out = mixing.mixed(docs)
    return out.filter(F.col(out.columns[-1]) > 0)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources", mix),
]

#: Compression bands and knapsack programmes have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
