"""One place for the session settings used by tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, in the shared folder that spark.checkpoint.dir names.

    Where that is unset, a new local folder on a local master (tests), and an error on a cluster.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="codelode-checkpoint-"))
    return df.checkpoint()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Local session; on a cluster the caller's own session is passed instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName("codelode")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
