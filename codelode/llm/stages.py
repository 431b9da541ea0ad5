"""The corpus pipeline's stages: each applies one operator and returns what it keeps, with the columns of documents.

Defined results: every stage takes nulls, empty texts, repeated rows and empty tables as its operator does; a stage drops
only what its operator rejects, and keeps other rows whole. Extra columns of documents ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .decontamination import without_leaks
from .near_duplicates import near_duplicates
from .packing import pack
from .pii_surrogates import pseudonymized, session_params
from .quality_divergence import fit_and_judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return fit_and_judge(docs, keep=True).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    bounded_batches(spark)
    dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; documents without an id go together, as nothing tells them apart."""
    bounded_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars is counted anew."""
    bounded_batches(spark)
    spans = "entities"
    while spans in docs.columns:
        spans = f"_{spans}"
    out = pseudonymized(docs, session_params(spark), spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    bounded_batches(spark)
    return pack(docs)
