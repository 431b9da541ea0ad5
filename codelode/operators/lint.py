"""Style checks: line rules, lines of code, scores, and parsers of linter output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ladders

_LIMITS = {"javascript": 100, "ruby": 100, "go": 100, "java": 120, "php": 120}
_COMMENTS = {"python": "#", "ruby": "#", "javascript": "//", "java": "//", "go": "//", "php": "//"}


def _limit(language: Column) -> Column:
    out = None
    for x, n in _LIMITS.items():
        out = F.when(language == x, n) if out is None else out.when(language == x, n)
    return out


def line_warnings(lines: DataFrame) -> DataFrame:
    """file_id, line, ord, message of every line rule that a line breaks."""
    t, lang, bare = F.col("text"), F.col("language"), ladders.stripped(F.col("text"))
    limit, size = _limit(lang), F.length("text")
    checks = [
        ((lang == "javascript") & t.rlike(r"\bvar\s+\w+") & ~F.contains(F.substring_index(t, "var", 1), F.lit("//")), F.lit("Use 'let' or 'const' instead of 'var'")),
        ((lang == "javascript") & t.rlike(" [=!]= ") & ~F.contains(t, F.lit("//")), F.lit("Use '===' or '!==' for strict equality")),
        ((lang == "php") & F.contains(t, F.lit("<? ")) & ~F.contains(t, F.lit("<?php")), F.lit("Use full PHP opening tag <?php instead of <?")),
        ((lang == "ruby") & bare.startswith("if ") & F.contains(t, F.lit("then")), F.lit("Avoid using 'then' in if statements")),
        (size > limit, F.format_string("Line too long (%d > %d)", size, limit)),
        ((lang == "java") & bare.startswith("import") & F.contains(t, F.lit(".*;")), F.lit("Avoid wildcard imports")),
    ]
    items = F.array(*[F.when(hit, F.struct(F.lit(i).alias("ord"), m.alias("message"))) for i, (hit, m) in enumerate(checks)])
    return lines.select("file_id", "line", "language", F.explode(F.array_compact(items)).alias("w")).select("file_id", "line", "language", "w.ord", "w.message")


def lines_of_code(lines: DataFrame) -> DataFrame:
    """file_id, language, loc: lines that are neither blank nor comments; in PHP only inside its blocks."""
    text, bare = F.col("text"), ladders.stripped(F.col("text"))
    prefix = None
    for x, p in _COMMENTS.items():
        prefix = F.when(F.col("language") == x, p) if prefix is None else prefix.when(F.col("language") == x, p)
    state = F.when(F.contains(text, F.lit("?>")), 0).when(F.contains(text, F.lit("<?php")) | F.contains(text, F.lit("<?=")), 1)
    inside = F.last(state, ignorenulls=True).over(W.partitionBy("file_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    counted = (bare != "") & ~bare.startswith(prefix) & ((F.col("language") != "php") | (F.coalesce("_in", F.lit(0)) == 1))
    return lines.withColumn("_in", inside).groupBy("file_id", "language").agg(F.count_if(counted).alias("loc"))


def items(lines: DataFrame, runs: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """file_id, tool, line, severity, message of all linters: what the tools said (tool_items), the line rules, and more."""
    own = line_warnings(lines).select("file_id", F.lit("manual").alias("tool"), "line", F.lit("warning").alias("severity"), "message")
    own = own if more is None else own.unionByName(more)
    return own if runs is None else tool_items(runs).unionByName(own)


def lint_results(lines: DataFrame, runs: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """file_id, errors, warnings, infos, score, passed, complexity, from the line rules, the tools' runs and more items."""
    kinds = {"errors": "error", "warnings": "warning", "infos": "info"}
    sums = items(lines, runs, more).groupBy("file_id").agg(*[F.count_if(F.col("severity") == k).alias(c) for c, k in kinds.items()])
    df = lines.select("file_id").distinct().join(sums, "file_id", "left").na.fill(0, list(kinds))
    return df.withColumns(
        {
            "score": ladders.lint_score(F.col("errors"), F.col("warnings"), F.col("infos")),
            "passed": F.col("errors") == 0,
            "complexity": F.col("errors") + F.col("warnings"),
        }
    )


def parse_pylint(raw: Column) -> Column:
    """Struct of line, col, code, message and severity of an output line, or null."""
    p = r"^.*?:(\d+):(\d+):\s*([A-Z]\d+):\s*(.+)$"
    g = [F.regexp_extract(raw, p, i) for i in range(1, 5)]
    kind = F.substring(g[2], 1, 1)
    severity = F.when(kind.isin("E", "F"), "error").when(kind == "W", "warning").otherwise("info")
    return F.when(raw.rlike(p), F.struct(g[0].cast("int").alias("line"), g[1].cast("int").alias("col"), g[2].alias("code"), g[3].alias("message"), severity.alias("severity")))


def parse_flake8(raw: Column) -> Column:
    """file:line:col: code message; the message ends at the next colon and is the code itself where nothing follows it."""
    parts = F.split(raw, ":")
    said = F.trim(F.get(parts, F.lit(3)))
    code = F.substring_index(said, " ", 1)
    message = F.when(F.contains(said, F.lit(" ")), F.substring(said, F.length(code) + 2, F.length(said))).otherwise(said)
    return F.when(
        F.size(parts) >= 4,
        F.struct(F.get(parts, F.lit(1)).cast("int").alias("line"), code.alias("code"), message.alias("message"), F.when(code.rlike("E9|F4|F6|F7|F8|F82"), "error").otherwise("warning").alias("severity")),
    )


def parse_govet(raw: Column) -> Column:
    parts = F.split(raw, ":", 4)
    message = F.trim(F.get(parts, F.lit(3)))
    low = F.lower(message)
    severity = F.when(low.rlike("insecure|unsafe|injection"), "HIGH").when(low.rlike("error|fatal|panic"), "CRITICAL").otherwise("MEDIUM")
    return F.when(F.size(parts) == 4, F.struct(F.get(parts, F.lit(1)).cast("int").alias("line"), message.alias("message"), severity.alias("severity")))


def parse_eslint(raw: Column) -> Column:
    """Array of line, rule, severity and message out of the tool's JSON."""
    doc = F.from_json(raw, "array<struct<messages:array<struct<line:int,ruleId:string,severity:int,message:string>>>>")
    flat = F.flatten(F.transform(doc, lambda d: d["messages"]))
    kind = lambda m: F.when(F.contains(F.lower(m["message"]), F.lit("eval")), "CRITICAL").when(m["severity"] == 2, "HIGH").otherwise("MEDIUM")
    return F.transform(flat, lambda m: F.struct(m["line"].alias("line"), m["ruleId"].alias("rule"), kind(m).alias("severity"), m["message"].alias("message")))


#: Exit codes after which a tool's output counts; other tools' output always does.
GOOD_EXITS = {"pylint": [0, 4, 8, 16, 28], "eslint": [0, 1], "bandit": [0, 1]}
#: How many items of each severity a result lists.
LISTED = {"error": 50, "warning": 50, "info": 20}


def _item(line: Column, severity: Column, message: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), severity.alias("severity"), message.alias("message"))


def _each(text: Column, made) -> Column:
    """Items of the lines of text for which made gives one."""
    return F.array_compact(F.transform(F.split(text, "\n"), made))


def eslint_items(raw: Column) -> Column:
    """Lint items of eslint's JSON; output that is no JSON gives its lines that speak of errors or warnings."""
    doc = F.from_json(raw, "array<struct<messages:array<struct<line:int,column:int,severity:int,message:string>>>>")
    flat = F.flatten(F.transform(doc, lambda d: d["messages"]))
    parsed = F.transform(flat, lambda m: _item(F.coalesce(m["line"], F.lit(1)), F.when(m["severity"] == 2, "error").otherwise("warning"), F.coalesce(m["message"], F.lit(""))))
    plain = _each(raw, lambda x: F.when(F.lower(x).rlike("error|warning"), _item(F.lit(1), F.lit("warning"), F.substring(x, 1, 200))))
    return F.when(F.ltrim(raw).startswith("["), F.coalesce(parsed, F.array().cast("array<struct<line:int,severity:string,message:string>>"))).otherwise(plain)


def jshint_items(raw: Column) -> Column:
    doc = F.from_json(raw, "array<struct<errors:array<struct<line:int,code:string,reason:string>>>>")
    flat = F.flatten(F.transform(doc, lambda d: d["errors"]))
    kind = lambda m: F.when(F.coalesce(m["code"], F.lit("")).startswith("E"), "error").otherwise("warning")
    return F.transform(flat, lambda m: _item(F.coalesce(m["line"], F.lit(1)), kind(m), F.coalesce(m["reason"], F.lit(""))))


def javac_failure(stderr: Column) -> Column:
    """A failed compilation is its first line."""
    first = F.when(stderr == "", "Compilation failed").otherwise(F.substring_index(stderr, "\n", 1))
    return F.array(_item(F.lit(1), F.lit("error"), F.substring(first, 1, 200)))


def javac_warning(x: Column) -> Column:
    return F.when(F.contains(F.lower(x), F.lit("warning:")), _item(F.lit(1), F.lit("warning"), F.substring(ladders.stripped(x), 1, 200)))


def php_item(x: Column) -> Column:
    place = F.when(x.rlike(r"line \d+"), F.regexp_extract(x, r"line (\d+)", 1)).otherwise("1")
    return F.when(F.contains(x, F.lit("Parse error:")), _item(place, F.lit("error"), F.trim(F.substring_index(x, "Parse error:", -1))))


def ruby_item(x: Column) -> Column:
    return F.when(x.rlike(r":\d+:"), _item(F.regexp_extract(x, r":(\d+):", 1), F.lit("error"), ladders.stripped(x)))


def go_item(x: Column) -> Column:
    """file:line:message; what is unused is a warning."""
    kind = F.when(F.lower(x).rlike("warning|unused|not used"), "warning").otherwise("error")
    return F.when(x.rlike(r":\d+:"), _item(F.regexp_extract(x, r":(\d+):", 1), kind, F.trim(F.get(F.split(x, ":", 3), F.lit(2)))))


def tool_items(runs: DataFrame) -> DataFrame:
    """file_id, tool, line, severity, message out of runs: file_id, tool, exit_code, stdout, stderr.

    Tools that print a line for each item are taken line by line, the others as a whole: two plans of moderate expressions.
    """
    tool, out, err, code = F.col("tool"), F.col("stdout"), F.col("stderr"), F.col("exit_code")
    bad = None
    for name, codes in GOOD_EXITS.items():
        one = (tool == name) & ~code.isin(codes)
        bad = one if bad is None else bad | one
    good = runs.filter(~bad)
    columns = ["file_id", "tool", "i.line", "i.severity", "i.message"]

    by_line = tool.isin("pylint", "flake8") | ((tool == "javac") & (code == 0)) | (tool.isin("php", "ruby", "go") & (code != 0))
    x = F.col("x")
    each = good.filter(by_line).select("file_id", "tool", F.explode(F.split(F.when(tool.isin("pylint", "flake8"), out).otherwise(err), "\n")).alias("x"))
    said = lambda parsed: F.when(parsed.isNotNull(), _item(parsed["line"], parsed["severity"], parsed["message"]))
    item = (
        F.when(tool == "pylint", said(parse_pylint(x)))
        .when(tool == "flake8", said(parse_flake8(x)))
        .when(tool == "javac", javac_warning(x))
        .when(tool == "php", php_item(x))
        .when(tool == "ruby", ruby_item(x))
        .when(tool == "go", go_item(x))
    )
    lined = each.select("file_id", "tool", item.alias("i")).filter("i is not null").select(*columns)

    found = (
        F.when(tool == "eslint", eslint_items(out))
        .when(tool == "jshint", jshint_items(out))
        .when((tool == "javac") & (code != 0), javac_failure(err))
        .when((tool == "gofmt") & (F.trim(out) != ""), F.array(_item(F.lit(1), F.lit("warning"), F.lit("Code not formatted with gofmt"))))
    )
    whole = good.filter(tool.isin("eslint", "jshint", "javac", "gofmt")).select("file_id", "tool", F.explode(found).alias("i")).select(*columns)
    return lined.unionByName(whole)


def listed(found: DataFrame) -> DataFrame:
    """The items a result lists: the first of each file and severity, by tool, line and message."""
    return ranked(found).filter("listed").drop("listed")


def ranked(found: DataFrame) -> DataFrame:
    """Items with rank, their place in the file and severity by tool, line and message, and listed: whether a result lists it."""
    limit = None
    for kind, n in LISTED.items():
        limit = F.when(F.col("severity") == kind, n) if limit is None else limit.when(F.col("severity") == kind, n)
    place = W.partitionBy("file_id", "severity").orderBy("tool", "line", "message")
    return found.withColumn("rank", F.row_number().over(place)).withColumn("listed", F.col("rank") <= limit)


def java_class_name(code: Column) -> Column:
    """The name under which a source is compiled: its first class, or TempClass."""
    return F.when(code.rlike(r"class\s+\w+"), F.regexp_extract(code, r"class\s+(\w+)", 1)).otherwise("TempClass")


def parse_bandit(raw: Column) -> Column:
    """Findings of bandit's JSON; missing fields get the tool's defaults."""
    doc = F.from_json(raw, "struct<results:array<struct<line_number:int,issue_severity:string,issue_confidence:string,test_id:string,issue_text:string,code:string>>>")
    return F.transform(
        doc["results"],
        lambda i: F.struct(
            F.coalesce(i["line_number"], F.lit(1)).alias("line"),
            F.upper(F.coalesce(i["issue_severity"], F.lit("MEDIUM"))).alias("severity"),
            F.upper(F.coalesce(i["issue_confidence"], F.lit("MEDIUM"))).alias("confidence"),
            F.coalesce(i["test_id"], F.lit("unknown")).alias("rule_id"),
            F.coalesce(i["issue_text"], F.lit("Security issue")).alias("description"),
            F.substring(F.coalesce(i["code"], F.lit("")), 1, 100).alias("matched_text"),
        ),
    )
