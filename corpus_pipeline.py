"""From documents to packed training sequences: quality rules, near-dedup, decontamination, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import stages
from codelode.llm.common import stored, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: MinHash candidates, alignment, keyed permutations and tokenization have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
