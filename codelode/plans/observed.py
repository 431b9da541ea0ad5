"""Rows and times of the stages of a plan, observed while it runs, beside its result and without a pass of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Watches frames as their rows pass; a stage's time lasts from its first row to its last, on any executor."""

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{name}-{len(self._seen)}")
        self._seen.append((name, seen))
        now = F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("bigint")
        span = (F.max("_now") - F.min("_now")).alias("millis")
        return df.withColumn("_now", now).observe(seen, F.count(F.lit(1)).alias("rows"), F.min("_now").alias("began"), span).drop("_now")

    def rows(self) -> dict[str, int]:
        """Rows of each stage; waits for the plan to have run."""
        return {name: seen.get["rows"] for name, seen in self._seen}

    def times(self, spark: SparkSession) -> DataFrame:
        """stage, place, rows, began, millis (at least 1 of a stage that had rows) of all stages, in order."""
        got = [(name, i, seen.get) for i, (name, seen) in enumerate(self._seen)]
        made = [(name, i, g["rows"], g["began"], max(1, g["millis"]) if g["rows"] else 0) for name, i, g in got]
        return spark.createDataFrame(made, "stage string, place int, rows bigint, began bigint, millis bigint").select("stage", "place", "rows", F.timestamp_millis("began").alias("began"), "millis")
