"""Merkle manifest of a dataset: ordered leaves by source, an event-driven tree over combineByKey, proofs from reverse links.

Leaves are hashed in the JVM, written once as narrow rows and ordered by range, so a source of any size lies over many tasks;
a leaf's place in its source comes from the counts of the tasks before it. The tree is built by events: a digest goes to its
parent, whose size follows from its group's size. combineByKey gathers partial parents, each an index of child digests. A
parent whose children are all there gives out its own digest, an event for the next level, in the same task; what is left
unresolved, the frontier, is shuffled again by an ancestor some levels further up. A round leaves one node of 16^span for each
ancestor, so rounds are few. Every resolved parent is written as a link to its children; read in reverse, from the root down,
the links give each run of leaves its siblings on the way up, once for 16 leaves.

Defined results: a null is `-` in a leaf, so it differs from an empty value; integers are written in decimal. A null source is a
source of its own and comes first. Leaves of one source go by doc_id, a null one first, equal ones by their digests; rows that
are equal in every column have equal leaves and stand side by side. A null doc_id is never tampered with. No rows, no result. A
missing column of the five is an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.rdd import RDD, portable_hash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, table

#: Children of a node, and levels that a round's tasks resolve by themselves.
ARITY, SPAN = 16, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Group number of the tree over the sources' roots; the sources' own are 0, 1, ...
TOP = -1
_NODES = "done boolean, grp bigint, size bigint, level int, parent bigint, places array<int>, digests array<string>"


def encoded(value: Column) -> Column:
    """`-` if null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], encoded(text)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, tampered: Column | None = None, tampering=lower_ascii) -> DataFrame:
    """doc_id, source, leaf, offered: the digest of each row, and of the row as it is offered for the check."""
    text = F.col("text").cast("string")
    offered = F.when(tampered, leaf_digest(tampering(text))) if tampered is not None else F.lit(None)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(text).alias("leaf"), F.coalesce(offered, leaf_digest(text)).alias("offered"))


def placed(rows: DataFrame) -> DataFrame:
    """rows with grp (rank of the source), size (of the source), sources (how many) and i (place in the source).

    Rows are ordered by range and numbered in each task; a task's counts by source then give all places. Those counts are as
    many as there are tasks and sources together.
    """
    rows = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    keys = ["source", "doc_id", "leaf", "salt"]  # rows that are equal in all else are parted by the salt
    order = [F.asc_nulls_first(k) for k in keys]
    number = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", number)
    ordered = stored(ordered.select("*", F.shiftright("nth", 33).alias("task"), F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).drop("nth", "salt"), "ordered-leaves")
    pieces = stored(ordered.groupBy("task", "source").agg(F.min("row").alias("first"), F.count("*").alias("n")), "leaf-counts")
    by_source = W.partitionBy("source")
    earlier = by_source.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(by_source).alias("size"))
    # a source is numbered where its first row stands: those of earlier tasks, then those before it in the task
    begins = pieces.filter("before = 0").select("source", "task", F.row_number().over(W.partitionBy("task").orderBy("first")).alias("k"))
    tasks = begins.groupBy("task").agg(F.count("*").alias("s"))
    tasks = tasks.select("task", F.coalesce(F.sum("s").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(W.partitionBy()).alias("sources"))
    ranks = begins.join(F.broadcast(tasks), "task").select(F.col("source").alias("_source"), (F.col("base") + F.col("k") - 1).alias("grp"), "sources")
    same = F.col("source").eqNullSafe(F.col("_source"))
    ranked = pieces.join(ranks, same).select(F.col("task").alias("_task"), F.col("source").alias("_source"), (F.col("before") - F.col("first")).alias("shift"), "size", "grp", "sources")
    ranked = broadcast_if_small(stored(ranked, "leaf-places"), 100_000)
    joined = ordered.join(ranked, (F.col("task") == F.col("_task")) & same)
    return joined.select("doc_id", "source", "leaf", "offered", "grp", "size", "sources", (F.col("row") + F.col("shift")).alias("i"))


def level_size(size: int, level: int) -> int:
    """Nodes of a level in a tree over size leaves."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def arity(size: int, level: int, parent: int) -> int:
    """Children of a node of that level: what its group's size leaves for it."""
    return min(ARITY, level_size(size, level - 1) - ARITY * parent)


def digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _event(sources: int, grp: int, size: int, level: int, index: int, value: str) -> tuple | None:
    """What a finished node says to its parent: (key, {place: digest}); None from the root."""
    if level_size(size, level) == 1:
        if grp == TOP or sources == 1:
            return None
        grp, size, level, index = TOP, sources, 0, grp
    return (grp, size, level + 1, index // ARITY), {index % ARITY: value}


def _resolved(sources: int):
    def run(partials: Iterator[tuple]) -> Iterator[tuple]:
        """Links of the parents that become whole, then the frontier of those that do not."""
        open_ones: dict = {}
        for key, children in partials:
            while True:
                grp, size, level, parent = key
                have = open_ones.pop(key, None)
                if have:
                    children = have | children
                if len(children) < arity(size, level, parent):
                    open_ones[key] = children
                    break
                own = [children[k] for k in range(len(children))]
                yield True, grp, size, level, parent, list(range(len(own))), own
                event = _event(sources, grp, size, level, parent, digest(own))
                if event is None:
                    break
                key, children = event
        for (grp, size, level, parent), children in open_ones.items():
            yield False, grp, size, level, parent, list(children), list(children.values())

    return run


def _gathered(events: RDD, top: int, tasks: int) -> RDD:
    """Partial parents by combineByKey; all below one ancestor at level top meet in one task."""

    def place(key: tuple) -> int:
        grp, _, level, parent = key
        return portable_hash((grp, parent // ARITY ** max(0, top - level)))

    return events.combineByKey(dict, lambda a, b: a | b, lambda a, b: a | b, numPartitions=tasks, partitionFunc=place)


def links(nodes: DataFrame, sources: int, span: int = SPAN) -> list[DataFrame]:
    """grp, size, level, parent, digests (of its children in order) of all inner nodes, a frame for each round."""
    spark = nodes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def first(row) -> list[tuple]:
        event = _event(sources, row[0], row[1], 0, row[2], row[3])
        return [event] if event else []

    events, top, out = nodes.select("grp", "size", "i", "leaf").rdd.flatMap(first), span, []
    while True:
        made = _gathered(events, top, tasks).mapPartitions(_resolved(sources))
        made = stored(spark.createDataFrame(made, _NODES), "merkle-nodes")
        out.append(made.filter("done").select("grp", "size", "level", "parent", "digests"))
        frontier = made.filter("not done")
        if frontier.isEmpty():
            return out
        events = frontier.rdd.map(lambda r: ((r.grp, r.size, r.level, r.parent), dict(zip(r.places, r.digests))))
        top += span


def _children(above: DataFrame) -> DataFrame:
    """A node's children with their way up: the siblings before and after each, then the node's own way."""
    each = above.select("grp", "level", "parent", "digests", "path", "subroot", F.posexplode("digests").alias("k", "digest"))
    return each.select("grp", (F.col("level") - 1).alias("level"), (F.col("parent") * ARITY + F.col("k")).alias("index"), "digest", "subroot", F.concat(F.array(_siblings(F.col("digests"), F.col("k"))), "path").alias("path"))


def _siblings(digests: Column, k: Column) -> Column:
    """The run of a node without itself, as text before and after it."""
    before = F.array_join(F.slice(digests, F.lit(1), k), "")
    return F.struct(before.alias("before"), F.array_join(F.slice(digests, k + 2, F.lit(ARITY)), "").alias("after"))


def manifest(docs: DataFrame, tampered: Column | None = None, tampering=lower_ascii) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array of siblings before and after, from the leaf up), proof_sha256, folded_root, verified.

    tampered marks rows that are offered for the check in another form, which tampering makes out of their text.
    """
    spark = docs.sparkSession
    at = stored(placed(leaves(docs, tampered, tampering)), "placed-leaves")
    one = at.select("sources").limit(1).collect()
    if not one:
        return spark.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof array<struct<before: string, after: string>>, proof_sha256 string, folded_root string, verified boolean")
    sources = one[0]["sources"]
    rounds = links(at, sources)
    link = rounds[0]
    for more in rounds[1:]:
        link = link.unionByName(more)
    tops = link.groupBy((F.col("grp") == TOP).alias("top")).agg(F.max("level").alias("n")).collect()
    depth = {r["top"]: r["n"] for r in tops}
    none = F.array().cast("array<struct<before: string, after: string>>")

    # down the tree of the sources: each source's root and its way to the root
    if depth.get(True):
        over = link.filter(F.col("grp") == TOP)
        level = over.filter(F.col("level") == depth[True]).select("*", none.alias("path"), F.lit(None).cast("string").alias("subroot"))
        root = digest(level.select("digests").head()["digests"])
        for n in range(depth[True] - 1, 0, -1):
            level = over.filter(F.col("level") == n).join(_children(level).select(F.col("index").alias("parent"), "path", "subroot"), "parent")
        roots = _children(level).select(F.col("index").alias("grp"), F.col("digest").alias("subroot"), "path")
    elif depth.get(False):
        last = link.filter(F.col("level") == depth[False]).select("digests").head()["digests"]
        root = digest(last)
        roots = spark.range(1).select(F.col("id").alias("grp"), F.lit(root).alias("subroot"), none.alias("path"))
    else:
        root = at.select("leaf").head()["leaf"]
        roots = spark.range(1).select(F.col("id").alias("grp"), F.lit(root).alias("subroot"), none.alias("path"))

    # down the trees of the sources, which may differ in height: a source joins in at the level of its root
    own = link.filter(F.col("grp") != TOP)
    heads = own.filter((F.col("parent") == 0) & (F.col("size") <= F.pow(F.lit(ARITY), F.col("level")))).join(roots, "grp")
    heads = stored(heads, "merkle-heads")
    level = None
    for n in range(depth.get(False) or 0, 0, -1):
        here = heads.filter(F.col("level") == n)
        if level is not None:
            below = own.filter(F.col("level") == n).join(_children(level).select("grp", F.col("index").alias("parent"), "path", "subroot"), ["grp", "parent"])
            here = here.unionByName(below)
        level = here
    alone = at.filter("size = 1").join(roots, "grp").select("doc_id", "leaf", "offered", "subroot", "path")
    if level is not None:
        run = level.select("grp", F.col("parent").alias("run"), "digests", "path", "subroot")
        many = at.filter("size > 1").withColumn("run", F.expr(f"i div {ARITY}")).join(run, ["grp", "run"])
        own_run = _siblings(F.col("digests"), (F.col("i") % ARITY).cast("int"))
        alone = many.select("doc_id", "leaf", "offered", "subroot", F.concat(F.array(own_run), "path").alias("path")).unionByName(alone)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256)
    folded = F.aggregate("path", F.col("offered"), lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))
    out = alone.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.col("path").alias("proof"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document by hash of its id is offered with its letters lower-cased."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(table(spark, sf_dir, "documents"), tampered).drop("proof")


def _sql(levels: int = 6) -> str:
    """The same in SQL, levels unrolled (16^levels leaves of a source, and sources, at most)."""
    h = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
    parts = [f"""WITH d AS (SELECT row_number() OVER () AS r, *, coalesce(xor({crc}, 4294967295) % 5 = 0, false) AS bad FROM documents),
    e AS (SELECT r, doc_id, source, {h('text')} AS leaf, CASE WHEN bad THEN {h(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {h('text')} END AS offered FROM d),
    s0 AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d,
      count(*) OVER (PARTITION BY source) AS n, r FROM e)"""]  # fmt: skip
    up = lambda a, b: f"{b} AS (SELECT g, i // {ARITY} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + {ARITY - 1}) // {ARITY} AS n FROM {a} GROUP BY g, i // {ARITY})"
    parts += [up(f"s{k}", f"s{k + 1}") for k in range(levels)]
    parts.append(f"t0 AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM s{levels})")
    parts += [up(f"t{k}", f"t{k + 1}") for k in range(levels)]
    parts.append("w0 AS (SELECT r, g, i, offered AS f, '' AS p FROM s0 JOIN e USING (r))")
    tree = [("s", k) for k in range(levels)] + [("t", k) for k in range(levels)]
    for step, (name, k) in enumerate(tree):
        g, i = ("w.g", "w.i") if name == "s" else ("0", "w.g" if k == 0 else "w.i")
        parts.append(f"""j{step} AS (SELECT w.r, any_value({i}) AS i, w.f, w.p, any_value(c.n) AS n, coalesce(string_agg(c.d, '' ORDER BY c.i) FILTER (c.i < {i}), '') AS b,
      coalesce(string_agg(c.d, '' ORDER BY c.i) FILTER (c.i > {i}), '') AS a, any_value(w.g) AS own FROM w{step} w JOIN {name}{k} c ON c.g = {g} AND c.i // {ARITY} = {i} // {ARITY} GROUP BY w.r, w.f, w.p),
    w{step + 1} AS (SELECT r, own AS g, i // {ARITY} AS i, CASE WHEN n = 1 THEN f ELSE sha256(b || f || a) END AS f, CASE WHEN n = 1 THEN p ELSE p || b || a END AS p FROM j{step})""")
    end = len(tree)
    return ", ".join(parts) + f""" SELECT e.doc_id, e.leaf, x.d AS subroot, t.d AS root, sha256(w.p) AS proof_sha256, w.f AS folded_root, w.f = t.d AS verified
    FROM e JOIN s0 USING (r) JOIN s{levels} x ON x.g = s0.g JOIN w{end} w ON w.r = e.r CROSS JOIN t{levels} t"""


OP12_SQL = _sql()
