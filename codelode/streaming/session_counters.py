"""Running counters over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect

FILES_SCHEMA = "filename string, code string"


def running_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Streams JSON lines of files from a folder and counts them by language and status; write it in complete mode."""
    stream = spark.readStream.schema(FILES_SCHEMA).json(folder)
    return detect.gated(stream).groupBy(F.coalesce("language", F.lit("unknown")).alias("language"), "status").agg(F.count("*").alias("files"))
