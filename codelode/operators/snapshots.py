"""What differs between two snapshots of a tree of files, by name and content, without a version control system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """filename, old_filename, status (added, removed, changed or renamed) of files (filename, code) that differ.

    A file that is gone and one that is new with the same content are a renamed file; where several have that content, they
    pair up in the order of their names. Equal files have no row. Only names and digests are compared and shuffled.
    """
    old, new = (df.select("filename", F.sha2(F.coalesce("code", F.lit("")), 256).alias(d)).distinct() for df, d in ((before, "was"), (after, "now")))
    both = old.join(new, "filename", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    place = lambda d: F.row_number().over(W.partitionBy(d).orderBy("filename"))
    gone = both.filter("now is null").select(F.col("filename").alias("old_filename"), F.col("was").alias("digest"), place("was").alias("k"))
    fresh = both.filter("was is null").select("filename", F.col("now").alias("digest"), place("now").alias("k"))
    paired = gone.join(fresh, ["digest", "k"], "full_outer")
    status = F.when(F.col("old_filename").isNull(), "added").when(F.col("filename").isNull(), "removed").otherwise("renamed")
    moved = paired.select(F.coalesce("filename", "old_filename").alias("filename"), F.when(F.col("filename").isNotNull(), F.col("old_filename")).alias("old_filename"), status.alias("status"))
    kept = both.filter("was is not null and now is not null").select("filename", F.lit(None).cast("string").alias("old_filename"), F.lit("changed").alias("status"))
    return moved.unionByName(kept)


def to_review(before: DataFrame, after: DataFrame) -> DataFrame:
    """The files of after that a review looks at: those that are added, changed or renamed."""
    names = changes(before, after).filter("status <> 'removed'").select("filename")
    return after.join(names, "filename", "left_semi")
