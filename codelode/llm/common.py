"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]"
_BATCH_BYTES = str(8 << 20)
#: Items summed in one step by running_sum; keeps the work per text near linear.
_BLOCK = 256


def bounded_batches(spark: SparkSession) -> None:
    """Batches of rows go to Python in at most 8 MB, so tasks on long texts hold little at once (a setting of the session)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != _BATCH_BYTES:
        spark.conf.set(name, _BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a new local folder on a local master (tests), and an error on a cluster, whose machines share none.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="codelode-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def materialized(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like materialized, as compressed Parquet: for wide rows. The files stay in the shared folder for the session's life."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks df for broadcast only if it is counted to hold at most max_rows narrow rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join on key, which is unique in right; weight is a key's number of rows in left, total all of them.

    Keys that hold more than one in share of all rows are at most share many, as their weights sum to total at most: they
    are broadcast, so their rows stay where they are. The others are shuffled, none with more than that part of the rows.
    """
    hot = F.col(weight) * share > total
    few = F.broadcast(right.filter(hot))
    rest = left.join(few.select(F.col(key).alias("_hot_key")), F.col(key) == F.col("_hot_key"), "left_anti")
    return left.join(few, key).unionByName(rest.join(right.filter(~hot), key))


def running_sum(lengths: Column) -> Column:
    """Exclusive prefix sums of an array<bigint>; blocks keep very long arrays from quadratic copying."""

    def prefix(values: Column, first: Column) -> Column:
        out = F.aggregate(
            values,
            F.struct(F.array(first).alias("sums"), first.alias("total")),
            lambda acc, x: F.struct(
                F.concat(acc["sums"], F.array(acc["total"] + x)).alias("sums"), (acc["total"] + x).alias("total")
            ),
        )
        return out["sums"]

    n_blocks = F.ceil(F.size(lengths) / F.lit(_BLOCK)).cast("int")
    blocks = F.when(
        n_blocks > 0,
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))),
    ).otherwise(F.array().cast("array<array<bigint>>"))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
    firsts = prefix(totals, F.lit(0).cast("bigint"))
    each = F.zip_with(blocks, F.slice(firsts, 1, F.size(blocks)), lambda b, f: F.slice(prefix(b, f), 1, F.size(b)))
    return F.flatten(each)
