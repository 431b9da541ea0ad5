"""Nested intervals against parents climbed one by one, and a very deep file."""

import random

import pytest
from pyspark.sql import functions as F

from codelode.operators import graph, intervals

NODES = "file_id long, id long, parent_id long, last_id long, depth int, node_type string"


def forest(rng, n, deep):
    """Random trees in preorder: parents are open nodes, the last one more often in a deep tree."""
    rows, stack = [], []
    for i in range(n):
        while stack and rng.random() > deep:
            stack.pop()
        rows.append([i, stack[-1] if stack else None, i, len(stack), rng.choice(["FUNCTION_DEF", "CALL", "RETURN", "CALL"])])
        stack.append(i)
    for r in reversed(rows):
        if r[1] is not None:
            rows[r[1]][2] = max(rows[r[1]][2], r[2])
    return rows


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    files = {f: forest(rng, n, deep) for f, (n, deep) in enumerate([(1, 0.5), (2, 0.9), (64, 0.5), (65, 0.8), (200, 0.97), (130, 0.0)])}
    refs = [(f, r[0], f"v{rng.randrange(4)}", rng.choice(["def", "use"])) for f, rows in files.items() for r in rows for _ in range(rng.randrange(3))]
    nodes = spark.createDataFrame([(f, *r) for f, rows in files.items() for r in rows], NODES).repartition(3)
    return files, refs, nodes, spark.createDataFrame(refs, "file_id long, id long, var string, kind string")


def above(rows, i):
    while i is not None:
        yield i
        i = rows[i][1]


def test_nearest_function(case):
    files, _, nodes, _ = case
    got = {(r["file_id"], r["id"]): r["function"] for r in graph.with_function(nodes).collect()}
    assert got == {(f, r[0]): next((a for a in above(rows, r[0]) if rows[a][4] == "FUNCTION_DEF"), None) for f, rows in files.items() for r in rows}


def test_each_variable_below_once(case):
    files, refs, nodes, ref_table = case
    got = [tuple(r) for r in graph.lifted(nodes, ref_table).select("file_id", "id", "var", "kind").collect()]
    assert len(got) == len(set(got)) and set(got) == {(f, a, v, k) for f, i, v, k in refs for a in above(files[f], i)}


def test_counts_below(case):
    files, refs, nodes, ref_table = case
    got = {(r["file_id"], r["id"]): r["n"] for r in intervals.distinct_below(nodes, ref_table, ["var"], "n").collect()}
    want = {(f, r[0]): set() for f, rows in files.items() for r in rows}
    for f, i, v, _ in refs:
        for a in above(files[f], i):
            want[f, a].add(v)
    assert got == {k: len(v) for k, v in want.items()}
    rows = {(r["file_id"], r["id"]): (r["uses"], r["returns"]) for r in graph.function_summaries(nodes, ref_table).collect()}
    assert rows.keys() == {(f, r[0]) for f, rs in files.items() for r in rs if r[4] == "FUNCTION_DEF"}
    assert all(returns == any(files[f][i][4] == "RETURN" for i in range(a, files[f][a][2] + 1)) for (f, a), (_, returns) in rows.items())


def test_a_chain_of_20000_nodes(spark):
    n = 20_000
    nodes = spark.range(n).select(
        F.lit(1).cast("bigint").alias("file_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(n - 1).cast("bigint").alias("last_id"), F.col("id").cast("int").alias("depth"),
        F.when(F.col("id") % 3 == 0, "FUNCTION_DEF").when(F.col("id") == n - 1, "RETURN").otherwise("CALL").alias("node_type"),
    )
    refs = nodes.select("file_id", "id", F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("var"), F.when(F.col("id") % 2 == 0, "def").otherwise("use").alias("kind"))
    assert graph.with_function(nodes).filter("function = id - id % 3").count() == n
    summary = graph.function_summaries(nodes, refs)
    assert summary.filter("uses = 5 and returns").count() >= n / 3 - 5 and summary.count() == -(-n // 3)
    assert n * 5 - 60 < graph.subtree_definitions(nodes, refs).count() < n * 5
    for df in (summary, graph.subtree_definitions(nodes, refs)):
        assert "path" not in df.columns


def test_merge_nodes_keep_the_tree(spark):
    """Every node keeps its place among the others; merge nodes stand after their statements; intervals are those of the parents."""
    from codelode.operators import merges

    rng = random.Random(8)
    files = {f: forest(rng, 120, 0.8) for f in range(4)}
    for rows in files.values():
        for r in rows:
            r[4] = rng.choice(["IF_STATEMENT", "IF_STATEMENT", "ASSIGNMENT"])
    refs = [(f, r[0], f"v{rng.randrange(3)}", rng.choice(["def", "def", "use"])) for f, rows in files.items() for r in rows]
    made = [(f, *r[:4], 1, 0, r[4], f"n{r[0]}", f"c{r[0]}", "python", False) for f, rows in files.items() for r in rows]
    nodes = spark.createDataFrame(made, f"{NODES.replace(', node_type string', '')}, line long, col long, node_type string, name string, code string, language string, is_condition boolean")
    new, new_refs, joined = merges.with_merges(nodes, spark.createDataFrame(refs, "file_id long, id long, var string, kind string"))
    ends = {}
    for r in joined.collect():
        ends.setdefault((r["file_id"], r["dst"]), set()).add(r["src"])
    phis, table = 0, new.collect()
    for f, rows in files.items():
        got = sorted((r for r in table if r["file_id"] == f), key=lambda r: r["id"])
        assert [r["id"] for r in got] == list(range(len(got)))
        assert [r["code"] for r in got if r["node_type"] != "PHI_NODE"] == [f"c{r[0]}" for r in rows]
        under = [{i} for i in range(len(got))]
        for r in reversed(got):
            if r["parent_id"] is not None:
                assert r["parent_id"] < r["id"] and got[r["parent_id"]]["depth"] == r["depth"] - 1
                under[r["parent_id"]] |= under[r["id"]]
        assert all(under[r["id"]] == set(range(r["id"], r["last_id"] + 1)) for r in got)
        at = {r["code"]: r["id"] for r in got}
        defined = {(i, v) for g, i, v, k in refs if g == f and k == "def"}
        want = []
        for r in rows:
            kids = [c for c in rows if c[1] == r[0]][:2]
            if r[4] == "IF_STATEMENT" and len(kids) == 2:
                for v in ("v0", "v1", "v2"):
                    last = [max((i for i in range(c[0], c[2] + 1) if (i, v) in defined), default=None) for c in kids]
                    if None not in last:
                        want.append((at[f"c{r[2]}"], -r[0], v, at[f"c{r[1]}"] if r[1] is not None else None, {at[f"c{i}"] for i in last}))
        found = [(r["name"], r["parent_id"], ends[f, r["id"]]) for r in got if r["node_type"] == "PHI_NODE"]
        assert found == [(v, parent, last) for _, _, v, parent, last in sorted(want, key=lambda w: w[:3])]
        phis += len(found)
    assert phis > 20 and new_refs.count() == len(refs) + 2 * phis
    graphed = merges.edges_with_merges(nodes, spark.createDataFrame(refs, "file_id long, id long, var string, kind string"))
    assert graphed.count() == graphed.select("file_id", "src", "dst", "edge_type").distinct().count()
    assert graphed.filter("label like 'phi:%'").count() > 0
