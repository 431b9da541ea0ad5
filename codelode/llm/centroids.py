"""Centroid clustering in whole numbers: blocked float64 matrix products, exact by their bounds, and treeAggregate of sums.

Vectors become integers and are stored as blocks of rows. Each round every block meets the centroids in one matrix product,
|x|^2 - 2 x.c + |c|^2: all terms are whole numbers, and where d (max|x| + max|c|)^2 stays below 2^53 every partial sum in
float64 is exact, in any order of summation. Rows and centroids beyond that bound are compared by integers (64 bits, then
Python's own). Counts, sums and inertia of the blocks meet in treeAggregate, so the driver gets k rows of sums however many
vectors and tasks there are.

Defined results: a vector that is null, of another length, or with a null, NaN or infinite component takes no part and has no
row. Repeated vec_ids are vectors of their own; a null vec_id hashes to null and is a first centroid only after all others.
Equal hashes go by components. With fewer vectors than centroids there are so many centroids; without vectors, no row. Ties of
distances go to the smaller number, so of equal centroids only the first gets vectors, and an empty one stays where it is.
Distances and inertia that a long cannot hold are null; the clusters are right all the same. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

_OUT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
_BLOCK = "n int, kind string, data binary"
_ROWS = 8192
_LONG = 2**63


@dataclass(frozen=True)
class ClusterParams:
    dimensions: int = 64
    centroids: int = 16
    rounds: int = 3
    scale: int = 64
    seed: int = 1
    #: Depth of the tree in which tasks' sums meet.
    depth: int = 2


def usable(vectors: DataFrame, params: ClusterParams) -> DataFrame:
    """vec_id and embedding of the vectors that have all their components, each a finite number."""
    x = F.col("embedding").cast("array<double>")
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding"))
    return rows.filter((F.size("embedding") == params.dimensions) & F.coalesce(F.forall("embedding", good), F.lit(False)))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 where all results are below 2^61, else Python integers."""
    y = x * scale
    if (np.abs(y) < 2**61).all():
        return np.floor(y).astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _limit(bits: int, dimensions: int) -> int:
    """The largest magnitude m with dimensions * (m + m)^2 < 2^bits."""
    return math.isqrt((2**bits - 1) // dimensions) // 2


def _exact(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Squared distances to one centroid by integers, as Python integers where 64 bits may not do."""
    limit = _limit(63, x.shape[1])
    if x.dtype != object and int(np.abs(x).max(initial=0)) <= limit and max(map(abs, c)) <= limit:
        gap = x - np.array(c, dtype=np.int64)
        return (gap * gap).sum(axis=1).astype(object)
    gap = x.astype(object) - np.array(c, dtype=object)
    return (gap * gap).sum(axis=1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the squared distance (int64, or object beyond it)."""
    limit = _limit(53, x.shape[1])
    near = [j for j, c in enumerate(centroids) if max(map(abs, c)) <= limit]
    far = [j for j in range(len(centroids)) if j not in near]
    inside = np.array((np.abs(x).max(axis=1) <= limit), dtype=bool)
    if inside.all() and not far:
        return _by_product(x, centroids, near)
    best, distance = np.full(len(x), -1, dtype=np.int64), np.full(len(x), None, dtype=object)
    if near and inside.any():
        best[inside], found = _by_product(x[inside].astype(np.int64), centroids, near)
        distance[inside] = found.astype(object)
    for j, c in enumerate(centroids):
        rows = np.arange(len(x)) if j in far else np.flatnonzero(~inside)
        if len(rows):
            got = _exact(x[rows], c)
            less = np.array([b < 0 or (g, j) < (d, b) for g, d, b in zip(got, distance[rows], best[rows].tolist())], dtype=bool)
            best[rows[less]], distance[rows[less]] = j, got[less]
    return best, distance


def _by_product(x: np.ndarray, centroids: list[list[int]], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of rows and centroids within the bound, by one product in float64, every term a whole number below 2^53."""
    c = np.array([centroids[j] for j in numbers], dtype=np.float64)
    f = x.astype(np.float64)
    d = (f * f).sum(axis=1)[:, None] - 2.0 * (f @ c.T) + (c * c).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return np.array(numbers, dtype=np.int64)[at], d[np.arange(len(x)), at].astype(np.int64)


def _blocks(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                x = whole(_matrix(batch.column("embedding").slice(start, _ROWS)), scale)
                big = int(np.abs(x).max(initial=0))
                kind = "text" if x.dtype == object else "<i1" if big < 128 else "<i2" if big < 2**15 else "<i4" if big < 2**31 else "<i8"
                data = " ".join(map(str, x.ravel().tolist())).encode() if kind == "text" else x.astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], names=["n", "kind", "data"])

    return run


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _opened(n: int, kind: str, data: bytes) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.split()], dtype=object).reshape(n, -1)
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(n, -1)


def _gather(centroids: list[list[int]]):
    """What treeAggregate needs: the empty state, a block's step and the sum of two states, all in Python integers."""
    k, d = len(centroids), len(centroids[0])

    def empty():
        return [0] * k, np.zeros((k, d), dtype=object), [0] * k

    def step(state, row):
        x = _opened(*row)
        cluster, distance = nearest(x, centroids)
        counts, sums, inertia = list(state[0]), state[1].copy(), list(state[2])
        for j in np.unique(cluster).tolist():
            rows = x[cluster == j]
            small = rows.dtype != object and int(np.abs(rows).max(initial=0)) < 2**48
            counts[j] += len(rows)
            sums[j] += (rows if small else rows.astype(object)).sum(axis=0).astype(object)
            inertia[j] += sum(distance[cluster == j].tolist())
        return counts, sums, inertia

    def merged(a, b):
        return [x + y for x, y in zip(a[0], b[0])], a[1] + b[1], [x + y for x, y in zip(a[2], b[2])]

    return empty(), step, merged


def first_centroids(kept: DataFrame, params: ClusterParams) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:vec_id`; a bounded number of rows, taken by each task before they meet."""
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("h"), "embedding").orderBy(F.asc_nulls_last("h"), "embedding").limit(params.centroids)
    rows = [r["embedding"] for r in first.collect()]
    return whole(np.array(rows, dtype=np.float64), params.scale).tolist() if rows else []


def cluster(vectors: DataFrame, params: ClusterParams = ClusterParams()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    kept = usable(vectors, params)
    centroids = first_centroids(kept, params)
    if not centroids:
        return spark.createDataFrame([], _OUT)
    blocks = stored(kept.select("embedding").mapInArrow(_blocks(params.scale), _BLOCK), "vector-blocks").rdd.map(tuple)
    for _ in range(params.rounds):
        counts, sums, _ = blocks.treeAggregate(*_gather(centroids), params.depth)
        centroids = [[int(s) // n for s in row] if n else c for c, n, row in zip(centroids, counts, sums)]
    _, _, inertia = blocks.treeAggregate(*_gather(centroids), params.depth)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda v: v if v < _LONG else None
    of_cluster, of_all = [fits(v) for v in inertia], fits(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(whole(_matrix(batch.column("embedding")), params.scale), centroids)
                each = number.tolist()
                columns = [
                    batch.column("vec_id"), pa.array(number, pa.int32()), pa.array([fits(v) for v in distance.tolist()], pa.int64()),
                    pa.array([of_cluster[j] for j in each], pa.int64()), pa.array([of_all] * len(each), pa.int64()), pa.array([digests[j] for j in each]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _OUT.split(", ")])

    return kept.mapInArrow(run, _OUT)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(params: ClusterParams = ClusterParams()) -> str:
    """The same in SQL: components by place, rounds unrolled."""
    k, d, s = params.centroids, params.dimensions, params.scale
    parts = [f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {d}
      AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v::DOUBLE) OR isinf(v::DOUBLE))) = 0),
    x AS (SELECT r, unnest(range({d})) AS i, unnest(list_transform(e, lambda v: floor({s} * v)::BIGINT)) AS v FROM kept),
    firsts AS (SELECT r, row_number() OVER (ORDER BY sha256('{params.seed}:' || vec_id) NULLS LAST, e) - 1 AS j FROM kept),
    c0 AS (SELECT j, i, v FROM firsts JOIN x USING (r) WHERE j < {k})"""]  # fmt: skip
    for n in range(params.rounds + 1):
        parts.append(f"""d{n} AS (SELECT x.r, c.j, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{n} c USING (i) GROUP BY x.r, c.j),
    a{n} AS (SELECT r, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM d{n} GROUP BY r)""")
        if n < params.rounds:
            parts.append(f"""m{n} AS (SELECT a.j, x.i, sum(x.v) AS s, count(*) AS n FROM a{n} a JOIN x USING (r) GROUP BY a.j, x.i),
    c{n + 1} AS (SELECT c.j, c.i, CASE WHEN m.n IS NULL THEN c.v ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS v FROM c{n} c LEFT JOIN m{n} m USING (j, i))""")
    last = params.rounds
    return ", ".join(parts) + f""", h AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY j)
    SELECT vec_id, a.j::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM kept JOIN a{last} a USING (r) JOIN h USING (j)"""


OP11_SQL = _sql()
