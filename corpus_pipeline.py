"""Corpus pipeline: quality rules, near-dedup, redaction, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import shared_dir
from spindrift.llm.op2_mixing import in_training_order
from spindrift.llm.op3_simhash import keep_one_of_each, near_components
from spindrift.llm.op5_quality import drop_rejected
from spindrift.llm.op8_bpe import round_trip
from spindrift.llm.op10_pii import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return drop_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return keep_one_of_each(docs, near_components, k=5, similarity=0.8)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixed sequence over files by name and rows in them."""
    return in_training_order(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: its place in the mixed sequence (part and row), their number, ids and digests.

    The ids round-trip: decoded_sha256 is the digest of the redacted text's bytes.
    """
    placed = docs.select("doc_id", "source", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("sequence_part"), F.col("_metadata.row_index").alias("sequence_row"), "text")
    return round_trip(placed, keep=("source", "sequence_part", "sequence_row"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither SimHash components nor byte-level BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of all stages on ``documents``; each stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
