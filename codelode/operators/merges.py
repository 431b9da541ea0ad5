"""Merge nodes: where both branches of an if statement define a variable, a PHI_NODE after the statement stands for both.

The nodes of a file are numbered anew by running sums: a node's new id is its old one and the number of merge nodes put in
before it. A merge node follows the last node of its statement and has the statement's parent; where several follow one
node, those of inner statements come first, then in the order of their variables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, intervals


def merge_points(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, id (of the statement), var, first, second: the last definitions of a variable in the two branches."""
    branches = nodes.filter("node_type = 'IF_STATEMENT'").select("file_id", F.col("id").alias("parent_id"))
    children = nodes.join(branches, ["file_id", "parent_id"]).select("file_id", "parent_id", "id", "last_id")
    children = children.withColumn("b", F.row_number().over(W.partitionBy("file_id", "parent_id").orderBy("id"))).filter("b <= 2")
    both = graph.branch_merges(nodes, refs).withColumnRenamed("id", "parent_id").join(children, ["file_id", "parent_id"])
    # the last definition in a branch is the last one of its variable up to the branch's end
    marks = refs.filter("kind = 'def'").select("file_id", "var", F.col("id").alias("at"), F.col("id").alias("own"))
    every = both.select("file_id", "var", F.col("last_id").alias("at"), "parent_id", "b").unionByName(marks, allowMissingColumns=True)
    last = F.max("own").over(W.partitionBy("file_id", "var").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    found = every.withColumn("last", last).filter("b is not null")
    return found.groupBy("file_id", F.col("parent_id").alias("id"), "var").agg(F.max(F.when(F.col("b") == 1, F.col("last"))).alias("first"), F.max(F.when(F.col("b") == 2, F.col("last"))).alias("second"))


def with_merges(nodes: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and refs with merge nodes put in, and the data edges (file_id, src, dst, edge_type, label) from both branches."""
    points = merge_points(nodes, refs).join(nodes.select("file_id", "id", "last_id"), ["file_id", "id"])
    here = points.groupBy("file_id", F.col("last_id").alias("id")).agg(F.count("*").alias("_put"))
    of = intervals.sums_below(nodes, points.select("file_id", "id"), {"_below": F.lit(1)})
    own = points.groupBy("file_id", "id").agg(F.count("*").alias("_own"))
    before = F.sum("_put").over(W.partitionBy("file_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    counted = nodes.select("file_id", "id").join(here, ["file_id", "id"], "left").na.fill(0, ["_put"])
    ids = counted.select("file_id", "id", (F.col("id") + F.coalesce(before, F.lit(0))).alias("_new"))
    moved = nodes.join(ids, ["file_id", "id"]).join(of, ["file_id", "id"]).join(own, ["file_id", "id"], "left").na.fill(0, ["_own"])
    # a statement's own merge nodes stand after it, those of the statements below it are in its interval
    moved = moved.withColumn("_last", F.col("_new") + F.col("last_id") - F.col("id") + F.col("_below") - F.col("_own"))
    above = ids.select("file_id", F.col("id").alias("parent_id"), F.col("_new").alias("_parent"))
    moved = moved.join(above, ["file_id", "parent_id"], "left")
    kept = moved.select(*[{"id": F.col("_new"), "parent_id": F.col("_parent"), "last_id": F.col("_last")}.get(c, F.col(c)).alias(c) for c in nodes.columns])

    rank = F.row_number().over(W.partitionBy("file_id", "last_id").orderBy(F.desc("id"), "var"))
    place = ids.select("file_id", F.col("id").alias("last_id"), F.col("_new").alias("_base"))
    put = points.withColumn("_rank", rank).join(place, ["file_id", "last_id"]).withColumn("_phi", F.col("_base") + F.col("_rank"))
    put = put.join(moved.select("file_id", "id", "_parent", "depth", "language"), ["file_id", "id"])
    put = put.join(nodes.select("file_id", F.col("id").alias("last_id"), "line", "col"), ["file_id", "last_id"])
    code = F.format_string("%s = phi(%s, %s)", "var", "var", "var")
    given = {
        "id": F.col("_phi"), "parent_id": F.col("_parent"), "last_id": F.col("_phi"), "node_type": F.lit("PHI_NODE"), "ast_type": F.lit("phi"), "name": F.col("var"), "code": code, "is_condition": F.lit(False),
    }
    have = {"file_id", "depth", "language", "line", "col"}
    phi = put.select(*[given.get(f.name, F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    new_refs = refs.join(ids, ["file_id", "id"]).select("file_id", F.col("_new").alias("id"), "var", "kind")
    own_refs = put.select("file_id", F.col("_phi").alias("id"), "var", F.explode(F.array(F.lit("def"), F.lit("use"))).alias("kind"))
    ends = put.select("file_id", F.col("_phi").alias("dst"), "var", F.explode(F.array("first", "second")).alias("id")).join(ids, ["file_id", "id"])
    label = F.concat(F.lit("phi:"), "var")
    joined = ends.select("file_id", F.col("_new").alias("src"), "dst", F.lit("data").alias("edge_type"), label.alias("label"))
    return kept.unionByName(phi), new_refs.unionByName(own_refs), joined


def edges_with_merges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, src, dst, edge_type, label of the graph that has merge nodes; what its own rules give comes first."""
    n, r, joined = with_merges(nodes, refs)
    return graph.inserted(graph.labelled_edges(n, r), joined)
