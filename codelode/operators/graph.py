"""Program dependence graph over node tables: edges, features, taint.

nodes: file_id, id (preorder), parent_id, last_id (of the last node below it), depth, line, col, node_type, name, code,
language, is_condition; refs: file_id, id, var, kind ('def' or 'use').
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims, ladders
from ..session import kept
from . import intervals

CONTROL = ["IF_STATEMENT", "FOR_STATEMENT", "WHILE_STATEMENT"]
TERMINATORS = ["RETURN", "BREAK", "CONTINUE"]
EDGE_TYPES = ["control", "data", "call", "order", "structural"]
#: The order in which the kinds of edges are added.
ADDED = ["structural", "control", "data", "call", "order"]
SCANNED = ["ASSIGNMENT", "CALL", "EXPRESSION"]
_ORDER = ["line", "col", "id"]


def structural_edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id is not null").select("file_id", F.col("parent_id").alias("src"), F.col("id").alias("dst"))


def with_function(nodes: DataFrame) -> DataFrame:
    """Adds function: the nearest function a node is in, itself included, or null."""
    return intervals.nearest(nodes, F.col("node_type") == "FUNCTION_DEF", "function")


def _next_stop(*scope: str) -> Column:
    """Line of the next terminator on a later line of the same scope; running minima, so large files cost no more."""
    later = W.partitionBy(*scope).orderBy(F.desc("line")).rangeBetween(W.unboundedPreceding, -1)
    return F.min(F.when(F.col("node_type").isin(TERMINATORS), F.col("line"))).over(later)


def control_edges(nodes: DataFrame) -> DataFrame:
    """Control node to its body; a block child stands for its own children; none beyond a terminator of the same function
    on a line in between, and none to conditions."""
    return _control(nodes).drop("label")


def _control(nodes: DataFrame) -> DataFrame:
    written = F.col("ast_type") if "ast_type" in nodes.columns else F.lower("node_type")
    n = with_function(nodes).withColumn("stop", _next_stop("file_id", "function")).select("file_id", "id", "parent_id", "line", "node_type", "is_condition", "stop", F.concat(F.lit("control->body:"), written).alias("label"))
    control = n.filter(F.col("node_type").isin(CONTROL)).select("file_id", F.col("id").alias("src"), "stop", "label")
    n = n.drop("label")
    child = control.join(n.filter("not is_condition").drop("stop").withColumnRenamed("parent_id", "src"), ["file_id", "src"])
    direct = child.filter("node_type <> 'BLOCK'").select("file_id", "src", "stop", "label", F.col("id").alias("dst"), "line")
    blocks = child.filter("node_type = 'BLOCK'").select("file_id", "src", "stop", "label", F.col("id").alias("parent_id"))
    inner = blocks.join(n.filter(~F.col("node_type").isin(CONTROL)).drop("stop"), ["file_id", "parent_id"]).select("file_id", "src", "stop", "label", F.col("id").alias("dst"), "line")
    free = F.col("stop").isNull() | (F.col("stop") >= F.col("line"))
    return direct.unionByName(inner).filter(free).select("file_id", "src", "dst", "label").distinct()


def data_edges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """From the last earlier definition of a variable (not at a function's own node) to each node that uses or redefines it;
    label: the first such variable."""
    return _data(nodes, refs).select("file_id", "src", "dst", F.col("var").alias("label"))


def _data(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    per_node = refs.groupBy("file_id", "id", "var").agg(F.bool_or(F.col("kind") == "def").alias("defines"), F.bool_or(F.col("kind") == "use").alias("uses"))
    df = per_node.join(nodes.select("file_id", "id", "line", "col", (F.col("node_type") == "FUNCTION_DEF").alias("function")), ["file_id", "id"])
    place = W.partitionBy("file_id", "var").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("defines") & ~F.col("function"), F.col("id")), ignorenulls=True).over(place)
    df = df.withColumn("src", previous).filter("src is not null")
    redefined = F.col("defines") & ~F.col("function")
    used = F.col("uses") & (F.col("function") | ~F.col("defines"))
    # a node's definitions come before its uses, and variables in their order
    first = F.struct((~redefined).cast("int").alias("late"), F.col("var"))
    df = df.filter(redefined | used).groupBy("file_id", "src", F.col("id").alias("dst")).agg(F.min("var").alias("var"), F.min(first).alias("f"))
    return df.select("file_id", "src", "dst", "var", F.concat(F.when(F.col("f.late") == 0, "def->def:").otherwise("def->use:"), "f.var").alias("label"))


def call_edges(nodes: DataFrame, *more: str) -> DataFrame:
    """Calls to the last function definition of that name in the file."""
    functions = nodes.filter("node_type = 'FUNCTION_DEF'").groupBy("file_id", "name").agg(F.max("id").alias("dst"))
    calls = nodes.filter("node_type = 'CALL'").select("file_id", F.col("id").alias("src"), "name")
    label = F.concat(F.lit("calls:"), "name").alias("label")
    return calls.join(functions, ["file_id", "name"]).filter("src <> dst").select("file_id", "src", "dst", label).select("file_id", "src", "dst", *more)


def order_edges(nodes: DataFrame) -> DataFrame:
    """Neighbours in reading order with one parent and no terminator on a line strictly between."""
    place = W.partitionBy("file_id").orderBy(*_ORDER)
    ahead = [F.lead(c).over(place).alias(f"next_{c}") for c in ("id", "parent_id", "line")]
    df = nodes.select("file_id", "id", "parent_id", "line", _next_stop("file_id").alias("stop"), *ahead)
    df = df.filter("next_id is not null").filter(F.col("parent_id").eqNullSafe(F.col("next_parent_id")))
    free = F.col("stop").isNull() | (F.col("stop") >= F.col("next_line"))
    return df.filter(free).select("file_id", F.col("id").alias("src"), F.col("next_id").alias("dst"))


def labelled_edges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, src, dst, edge_type, label: all edges between nodes that are there, once for each pair and type.

    Each kind of edge is distinct by itself, so the union needs no further pass. The tables are dealt out by file once and
    written, as every kind reads them.
    """
    n, r = kept(nodes.repartition("file_id")), kept(refs.repartition("file_id"))
    parts = {
        "control": _control(n),
        "data": _data(n, r).select("file_id", "src", "dst", "label"),
        "call": call_edges(n, "label"),
        "order": order_edges(n).withColumn("label", F.lit("order")),
        "structural": structural_edges(n).withColumn("label", F.lit("parent-child")),
    }
    each = [df.withColumn("edge_type", F.lit(kind)) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, each).filter("src <> dst").select("file_id", "src", "dst", "edge_type", "label")


def edges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """All edges with their type, once for each pair and type, between nodes that are there."""
    return labelled_edges(nodes, refs).drop("label")


def inserted(labelled: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Edges as they go into a graph: of several with the same ends and type the one added first stays, label and all.

    Kinds are added in the order of ADDED; more (the same columns) after all of them.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in ADDED]), F.col("edge_type"))
    every = labelled.withColumn("place", place)
    if more is not None:
        every = every.unionByName(more.withColumn("place", F.lit(len(ADDED) + 1).cast("bigint")))
    return every.groupBy("file_id", "src", "dst", "edge_type").agg(F.min_by("label", F.struct("place", "label")).alias("label"))


def edge_records(labelled: DataFrame) -> DataFrame:
    """An edge as a record for export: source, target, type, label, weight."""
    return inserted(labelled).select("file_id", F.col("src").alias("source"), F.col("dst").alias("target"), F.concat(F.col("edge_type"), F.lit("_dependency")).alias("type"), "label", F.lit(1.0).alias("weight"))


def simple_graph(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, src, dst, edge_type, label, weight: one edge for each pair of nodes, that of the type that is added last."""
    place = F.array_position(F.array(*[F.lit(x) for x in ADDED]), F.col("edge_type"))
    last = F.max_by(F.struct("edge_type", "label"), place)
    return inserted(labelled_edges(nodes, refs)).groupBy("file_id", "src", "dst").agg(last.alias("e")).select("file_id", "src", "dst", "e.edge_type", "e.label", F.lit(1.0).alias("weight"))


def node_records(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """A node as a record for export: code cut to 100 characters, names by kind, flags, sorted variables."""
    by = refs.groupBy("file_id", "id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("var")))).alias(c) for k, c in (("def", "variables_defined"), ("use", "variables_used"))]
    )
    t, none = F.col("node_type"), F.array().cast("array<string>")
    return nodes.join(by, ["file_id", "id"], "left").select(
        "file_id", "id", F.substring("code", 1, 100).alias("code"), "line", "col", F.lower("node_type").alias("type"),
        F.when(t == "FUNCTION_DEF", F.col("name")).alias("function_name"), F.when(t == "CLASS_DEF", F.col("name")).alias("class_name"),
        *[F.coalesce(c, none).alias(c) for c in ("variables_defined", "variables_used")],
        t.isin(CONTROL).alias("is_control_node"), t.isin(TERMINATORS).alias("is_control_terminator"), (t == "PHI_NODE").alias("is_phi_node"),
    )


def _by_language(made: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for language, value in made.items():
        hit = F.lower("language") == language
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def is_source(literal: bool = False) -> Column:
    """Whether a node's code matches a taint source of its language (the sources are used as expressions, in any case).

    With literal they are taken as they are written, so `$_GET` is found, and only in that case of its letters.
    """
    if literal:
        held = lambda words: reduce(lambda a, b: a | b, [F.contains(F.col("code"), F.lit(w)) for w in words])
        return _by_language({x: held(words) for x, words in dims.TAINT_SOURCES.items()}, F.lit(False))
    return _by_language({x: F.col("code").rlike("(?di)" + "|".join(f"(?:{p})" for p in ps)) for x, ps in dims.TAINT_SOURCES.items()}, F.lit(False))


def is_sanitized() -> Column:
    """Whether a node's code contains a sanitizer of its language."""
    return _by_language({x: reduce(lambda a, b: a | b, [F.contains(F.col("code"), F.lit(w)) for w in ws]) for x, ws in dims.SANITIZERS.items()}, F.lit(False))


def sink_types() -> Column:
    """Kinds of sinks whose expressions a node's code matches, in the order in which the later one wins."""
    kinds = list(dict.fromkeys(k for k, _ in dims.SINK_PATTERNS))
    hits = [F.when(F.col("code").rlike("(?di)" + "|".join(f"(?:{p})" for x, p in dims.SINK_PATTERNS if x == k)), F.lit(k)) for k in kinds]
    return F.array_compact(F.array(*hits))


def taint_seeds(nodes: DataFrame, refs: DataFrame, intent: bool = False) -> DataFrame:
    """file_id, id of calls that read from a source and define a variable.

    With intent: of assignments and declarations that read from a source in any node of theirs (the source as it is written) and define a
    variable, and of such calls; a call by itself hardly ever defines one.
    """
    if intent:
        at = intervals.nearest(nodes, F.col("node_type").isin("ASSIGNMENT", "VARIABLE"), "_assigned").filter(is_source(literal=True))
        own = at.filter("node_type = 'CALL'").select("file_id", "id")
        sources = at.filter("_assigned is not null").select("file_id", F.col("_assigned").alias("id")).unionByName(own)
        return refs.filter("kind = 'def'").join(sources, ["file_id", "id"], "left_semi").select("file_id", "id").distinct()
    sources = nodes.filter((F.col("node_type") == "CALL") & is_source()).select("file_id", "id")
    return refs.filter("kind = 'def'").join(sources, ["file_id", "id"], "left_semi").select("file_id", "id").distinct()


def taint_closure(seeds: DataFrame, data: DataFrame, nodes: DataFrame, refs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Defining nodes reachable from seeds over data edges without entering a sanitizing node.

    Semi-naive: each round joins only what is new. Steps and rounds are checkpointed, each round's new nodes as a piece of
    its own, so nothing is written twice and a lost executor costs no more than a round. A path has at most as many steps
    as a file has nodes; beyond max_rounds the data is taken to be wrong.
    """
    clean = nodes.filter(is_sanitized()).select("file_id", F.col("id").alias("dst"))
    defining = refs.filter("kind = 'def'").select("file_id", F.col("id").alias("dst")).distinct()
    step = data.join(clean, ["file_id", "dst"], "left_anti").join(defining, ["file_id", "dst"], "left_semi").select("file_id", F.col("src").alias("id"), "dst")
    step = kept(step.repartition("file_id"))
    pieces = [kept(seeds.select("file_id", "id").distinct())]
    for _ in range(max_rounds):
        new = pieces[-1].join(step, ["file_id", "id"]).select("file_id", F.col("dst").alias("id")).distinct()
        new = kept(new.join(reduce(DataFrame.unionByName, pieces), ["file_id", "id"], "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, pieces)
        pieces.append(new)
        if len(pieces) > 16:  # a long chain of small pieces becomes one
            pieces = [kept(reduce(DataFrame.unionByName, pieces[:-1]).coalesce(64)), pieces[-1]]
    raise RuntimeError("taint did not settle")


def taint_sinks(nodes: DataFrame, refs: DataFrame, tainted: DataFrame, data: DataFrame) -> DataFrame:
    """file_id, id, line, code (60 characters), type, defined, used of the nodes that look vulnerable.

    Those are calls, assignments and expressions of five characters or more that use a tainted variable (by name), match a
    sink's expression, and neither sanitize nor follow directly on a node that does. type is the last kind that matches.
    """
    names = refs.filter("kind = 'def'").join(tainted, ["file_id", "id"], "left_semi").select("file_id", "var").distinct()
    marked = nodes.withColumns({"clean": is_sanitized(), "types": sink_types()})
    clean = marked.filter("clean").select("file_id", F.col("id").alias("src"))
    long_enough = F.length(ladders.stripped(F.col("code"))) >= 5
    scanned = marked.filter(F.col("node_type").isin(SCANNED) & long_enough & ~F.col("clean") & (F.size("types") > 0))
    using = refs.filter("kind = 'use'").join(names, ["file_id", "var"], "left_semi").select("file_id", "id").distinct()
    after = data.join(clean, ["file_id", "src"], "left_semi").select("file_id", F.col("dst").alias("id"))
    found = kept(scanned.join(using, ["file_id", "id"], "left_semi").join(after, ["file_id", "id"], "left_anti"))
    rows = node_records(found, refs.join(found.select("file_id", "id"), ["file_id", "id"], "left_semi"))
    last = found.select("file_id", "id", F.element_at("types", -1).alias("vulnerability"))
    return rows.join(last, ["file_id", "id"]).select("file_id", "id", "line", F.substring("code", 1, 60).alias("code"), F.col("vulnerability").alias("type"), F.col("variables_defined").alias("defined"), F.col("variables_used").alias("used"))


def taint_issues(nodes: DataFrame, refs: DataFrame, intent: bool = False) -> DataFrame:
    """The whole analysis of taint: seeds (intent: see taint_seeds), closure, sinks; every issue involves tainted input.

    Each step reads both tables, so they are made and written once.
    """
    nodes, refs = kept(nodes), kept(refs)
    data = kept(data_edges(nodes, refs))
    tainted = taint_closure(taint_seeds(nodes, refs, intent), data, nodes, refs)
    return taint_sinks(nodes, refs, tainted, data).withColumn("tainted", F.lit(True))


def graph_stats(nodes: DataFrame, all_edges: DataFrame, issues: DataFrame) -> DataFrame:
    """file_id, nodes, edges, issues of every file that has nodes."""
    df = nodes.groupBy("file_id").agg(F.count("*").alias("nodes"))
    df = df.join(all_edges.groupBy("file_id").agg(F.count("*").alias("edges")), "file_id", "left")
    return df.join(issues.groupBy("file_id").agg(F.count("*").alias("issues")), "file_id", "left").na.fill(0, ["edges", "issues"])


def lifted(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """refs of each node and of all nodes below it, each variable and kind once."""
    return intervals.below(nodes, refs, ["var", "kind"])


def call_name(code: Column) -> Column:
    """The name a call's code calls: what stands before the first parenthesis, after its last dot."""
    return F.when(F.contains(code, F.lit("(")), F.trim(F.substring_index(F.substring_index(code, "(", 1), ".", -1)))


def child_names(nodes: DataFrame) -> DataFrame:
    """file_id, id, name of functions and classes: the code of their first child that is an identifier or a name."""
    named = nodes.filter(F.col("ast_type").isin("identifier", "name")).groupBy("file_id", F.col("parent_id").alias("id")).agg(F.min_by("code", "id").alias("name"))
    return nodes.filter(F.col("node_type").isin("FUNCTION_DEF", "CLASS_DEF")).select("file_id", "id").join(named, ["file_id", "id"], "left")


def features(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, idx (dense), features: length of the code, line, col, depth, flags of control, function, terminator and phi
    nodes, numbers of variables defined and used, one-hot of the 24 node types."""
    counts = refs.groupBy("file_id", "id").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("var"))).alias(c) for k, c in (("def", "defs"), ("use", "uses"))])
    df = nodes.join(counts, ["file_id", "id"], "left").na.fill(0, ["defs", "uses"])
    t = F.col("node_type")
    numbers = [F.length("code"), F.col("line"), F.col("col"), F.col("depth"), t.isin(CONTROL), t == "FUNCTION_DEF", t.isin(TERMINATORS), t == "PHI_NODE", F.col("defs"), F.col("uses")]
    hot = [t == k for k in dims.ALL_NODE_TYPES]
    idx = F.row_number().over(W.partitionBy("file_id").orderBy("id")) - 1
    return df.select("file_id", idx.alias("idx"), F.array(*[c.cast("double") for c in (*numbers, *hot)]).alias("features"))


def function_summaries(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, id, uses (distinct variables used below), returns (whether a return is below) of each function."""
    used = intervals.distinct_below(nodes, refs.filter("kind = 'use'"), ["var"], "uses")
    stops = intervals.sums_below(nodes, nodes.filter("node_type = 'RETURN'").select("file_id", "id"), {"stops": F.lit(1)})
    functions = nodes.filter("node_type = 'FUNCTION_DEF'").select("file_id", "id")
    return functions.join(used, ["file_id", "id"]).join(stops, ["file_id", "id"]).select("file_id", "id", "uses", (F.col("stops") > 0).alias("returns"))


def subtree_definitions(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, id, var: each variable defined in a node's subtree, once."""
    return intervals.below(nodes, refs.filter("kind = 'def'"), ["var"])


def branch_merges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, id, var: variables defined in the first and the second branch of an if statement."""
    branches = nodes.filter("node_type = 'IF_STATEMENT'").select("file_id", F.col("id").alias("parent_id"))
    children = nodes.join(branches, ["file_id", "parent_id"]).select("file_id", "parent_id", "id")
    children = children.withColumn("_b", F.row_number().over(W.partitionBy("file_id", "parent_id").orderBy("id"))).filter("_b <= 2")
    defined = children.join(subtree_definitions(nodes, refs), ["file_id", "id"]).select("file_id", F.col("parent_id").alias("id"), "var", "_b")
    return defined.groupBy("file_id", "id", "var").agg(F.countDistinct("_b").alias("n")).filter("n = 2").select("file_id", "id", "var")


def edge_index(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """file_id, src_idx, dst_idx, type_ord over dense node numbers; edges with unknown ends drop out."""
    dense = nodes.select("file_id", "id", (F.row_number().over(W.partitionBy("file_id").orderBy("id")) - 1).alias("idx"))
    df = all_edges.join(dense.select("file_id", F.col("id").alias("src"), F.col("idx").alias("src_idx")), ["file_id", "src"])
    df = df.join(dense.select("file_id", F.col("id").alias("dst"), F.col("idx").alias("dst_idx")), ["file_id", "dst"])
    place = F.array_position(F.array(*[F.lit(x) for x in EDGE_TYPES]), F.col("edge_type")) - 1
    return df.select("file_id", "src_idx", "dst_idx", place.cast("int").alias("type_ord"))


def semantic_tags(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """file_id, id, tags: sorted words for control structures, terminators, functions, classes, definitions and uses."""
    counts = refs.groupBy("file_id", "id").agg(F.bool_or(F.col("kind") == "def").alias("d"), F.bool_or(F.col("kind") == "use").alias("u"))
    df = nodes.join(counts, ["file_id", "id"], "left")
    t = F.col("node_type")
    tags = [
        F.when(t.isin(CONTROL), "control_structure"), F.when(t.isin(TERMINATORS), "control_terminator"), F.when(t == "FUNCTION_DEF", F.concat(F.lit("function:"), "name")),
        F.when(t == "CLASS_DEF", F.concat(F.lit("class:"), "name")), F.when(F.col("d"), "defines"), F.when(F.col("u"), "uses"),
    ]
    return df.select("file_id", "id", F.array_join(F.array_sort(F.array_compact(F.array(*tags))), ",").alias("tags"))


def valid_variables(names: DataFrame) -> DataFrame:
    """Rows (language, name) whose name can be a variable: no keyword, no builtin, begins with a letter or underscore."""
    bare = F.regexp_replace("name", r"^\$", "")
    bad = None
    for x in dims.LANGUAGES:
        words, builtins = dims.KEYWORDS[x], dims.BUILTINS[x]
        hit = (F.col("language") == x) & (F.lower(bare).isin(words) | bare.isin(builtins))
        bad = hit if bad is None else bad | hit
    return names.filter(~bad & bare.rlike(r"^[\p{L}_]"))
