"""Trees as nested intervals: what a subtree holds, without a row for each node and ancestor.

nodes: file_id, id (preorder), last_id (of the last node below, or its own), depth (0 for a root). A node is below another
where its id lies in the other's interval. Sums over a subtree are differences of running sums; the node of a given depth
above another is the last one of that depth that began before it; the deepest node above two others has the least depth of
the nodes after the first, up to the second, less one. Windows are over one file, sorted once, so a file of n nodes costs
n log n, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest(nodes: DataFrame, kind: Column, name: str) -> DataFrame:
    """Adds name: the id of the nearest node of that kind that a node is in, itself included, or null.

    Where so many intervals of the kind are open, the innermost is the one that began last among those that so many were
    open in when it had begun.
    """
    opens = nodes.withColumns({"_at": F.col("id"), "_step": kind.cast("int"), "_kind": kind})
    closes = nodes.filter(kind).select("file_id", (F.col("last_id") + 1).alias("_at"), F.lit(-1).alias("_step"))
    so_far = W.partitionBy("file_id").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    each = opens.unionByName(closes, allowMissingColumns=True).withColumn("_open", F.sum("_step").over(so_far)).filter("_kind is not null")
    began = F.max(F.when(F.col("_kind"), F.col("id"))).over(W.partitionBy("file_id", "_open").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn(name, F.when(F.col("_open") > 0, began)).select(*nodes.columns, name)


def _least_depth(nodes: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and least: the least depth of the nodes with ids from lo to hi, for ranges (file_id, lo, hi and keys).

    Ids fall into blocks of 1, 2, 4, ... of them; a range is at most two blocks of each size, so no range is walked through.
    """
    levels = F.floor(F.log2(F.max("id").over(W.partitionBy("file_id")) + 1)).cast("int")
    sized = nodes.withColumn("_levels", levels).select("file_id", "id", "depth", F.explode(F.sequence(F.lit(0), F.col("_levels"))).alias("_k"))
    block = F.floor(F.col("id") / F.pow(F.lit(2), "_k")).cast("bigint")
    least = sized.groupBy("file_id", "_k", block.alias("_block")).agg(F.min("depth").alias("_least"))

    # a range of n ids holds no block of more than n
    most = F.length(F.bin(F.col("hi") - F.col("lo") + 1)) - 1
    each = ranges.select("file_id", *keys, "lo", "hi", F.explode(F.sequence(F.lit(0), most)).alias("_k"))
    # the first block that begins at lo or later, and the one that is not over at hi
    each = each.select("file_id", *keys, "_k", F.expr("shiftright(lo + shiftleft(1L, _k) - 1, _k)").alias("_low"), F.expr("shiftright(hi + 1, _k)").alias("_high")).filter("_low < _high")
    blocks = F.array(F.when(F.col("_low") % 2 == 1, F.col("_low")), F.when(F.col("_high") % 2 == 1, F.col("_high") - 1))
    split = each.select("file_id", *keys, "_k", F.explode(blocks).alias("_block")).filter("_block is not null")
    return split.join(least, ["file_id", "_k", "_block"]).groupBy("file_id", *keys).agg(F.min("_least").alias("least"))


def _above(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (file_id, id, level and more) with above: the node of depth level that node id is in, or is."""
    every = asked.withColumn("_own", F.lit(None).cast("bigint")).unionByName(nodes.select("file_id", "id", F.col("depth").alias("level"), F.col("id").alias("_own")), allowMissingColumns=True)
    began = F.max("_own").over(W.partitionBy("file_id", "level").orderBy("id").rangeBetween(W.unboundedPreceding, 0))
    return every.withColumn("above", began).filter("_own is null").drop("_own")


def _occurrences(nodes: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Each node and key once, with the node's depth, the node before it with that key in the file (before), and shared: the
    depth of the deepest node both are in, -1 if there is none."""
    once = marks.select("file_id", "id", *keys).distinct().join(nodes.select("file_id", "id", "depth"), ["file_id", "id"])
    once = once.withColumn("before", F.lag("id").over(W.partitionBy("file_id", *keys).orderBy("id")))
    ranges = once.filter("before is not null").select("file_id", "id", *keys, (F.col("before") + 1).alias("lo"), F.col("id").alias("hi"))
    least = _least_depth(nodes, ranges, ["id", *keys])
    return once.join(least, ["file_id", "id", *keys], "left").withColumn("shared", F.coalesce(F.col("least") - 1, F.lit(-1)).cast("int")).drop("least")


def below(nodes: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """file_id, id, keys: each key of marks (file_id, id, keys) that occurs at a node or below it, once.

    An occurrence speaks for the nodes above it that do not hold the one before it too: those deeper than the deepest node
    both are in. So every row is made once.
    """
    each = _occurrences(nodes, marks, keys)
    asked = each.select("file_id", "id", *keys, F.explode(F.sequence(F.col("shared") + 1, F.col("depth").cast("int"))).alias("level"))
    return _above(nodes, asked).select("file_id", F.col("above").alias("id"), *keys)


def distinct_below(nodes: DataFrame, marks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """file_id, id, name: number of distinct keys at a node and below it, for every node.

    One for each occurrence, less one at the deepest node that it and the one before it are in.
    """
    each = _occurrences(nodes, marks, keys)
    ones = each.select("file_id", "id", F.lit(1).alias("_n"))
    twice = _above(nodes, each.filter("shared >= 0").select("file_id", "id", F.col("shared").alias("level"))).select("file_id", F.col("above").alias("id"), F.lit(-1).alias("_n"))
    return sums_below(nodes, ones.unionByName(twice), {name: F.col("_n")})


def sums_below(nodes: DataFrame, marks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """file_id, id and each sum over the marks (file_id, id, ...) of a node and of all below it."""
    own = marks.groupBy("file_id", "id").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    so_far = W.partitionBy("file_id").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    run = nodes.select("file_id", "id", "last_id").join(own, ["file_id", "id"], "left").na.fill(0, list(sums))
    run = run.select("*", *[F.sum(n).over(so_far).alias(f"_{n}") for n in sums])
    ends = run.select("file_id", F.col("id").alias("last_id"), *[F.col(f"_{n}").alias(f"_last_{n}") for n in sums])
    return run.join(ends, ["file_id", "last_id"]).select("file_id", "id", *[(F.col(f"_last_{n}") - F.col(f"_{n}") + F.col(n)).alias(n) for n in sums])
