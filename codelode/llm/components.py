"""Connected components of an edge table, without collecting links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialized


#: Edges that one task may well hold: a node of fewer is no hub, whatever its share.
_HUB = 2000


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its component for the edges (a, b); roots themselves are left out."""
    if len(a) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    edges: columns a, b (bigint, not null). Alternates large-star and small-star steps until no edge changes; the
    number of steps grows with the logarithm of the component size. Each round is checkpointed. A node of very many edges
    (a hub) is joined by broadcast, so its edges stay where they are.
    """
    current = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialized(current.distinct())
    before, n_edges, hubs = None, current.count(), True
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        linked = join_skewed(both, low, "a", "n", 2 * n_edges) if hubs else both.join(low, "a")
        large = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        current = materialized(small.filter(F.col("a") != F.col("b")).distinct())
        degrees = current.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))
        now = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor("h"), F.coalesce(F.max("n"), F.lit(0))).first()
        if now == before:
            break
        before, n_edges, hubs = now, now[0], now[2] * 1000 > 2 * now[0] and now[2] > _HUB
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
