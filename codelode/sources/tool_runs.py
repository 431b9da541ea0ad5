"""Runs of external linters as data: a table of their output, derived from events, the same in Spark and in SQL.

tool_runs: file_id, language, tool, exit_code, stdout, stderr; one row for each tool that ran on a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from .corpus import language_of, pick, quoted, sql_list

TOOLS = {
    "python": ["pylint", "flake8"],
    "java": ["javac", "javac"],
    "javascript": ["eslint", "jshint"],
    "php": ["php", "php"],
    "ruby": ["ruby", "ruby"],
    "go": ["gofmt", "go"],
}
_PYLINT = ["E", "W", "C", "R", "F"]
_FLAKE8 = ["E501", "F821", "W291", "E999"]
_JAVAC = ["error: ';' expected", "warning: [deprecation] old", "Note: done"]
_GO = ["undefined: y", "x declared and not used", "unused import"]
_EXITS = {"pylint": [0, 4, 8, 16, 28, 1, 32], "eslint": [0, 1, 2], "javac": [1, 0, 0], "php": [0, 255, 255], "ruby": [0, 1, 1], "go": [0, 1, 1]}


def _text(tool: Column, e: Column, n: Column) -> Column:
    """One line, or JSON object, of a tool's output for an event."""
    said = lambda pattern, *args: F.format_string(pattern, *args)
    return (
        F.when(tool == "pylint", said("f.py:%d:%d: %s0%d: message: %d", n, e % 80, pick(_PYLINT, e % 5), e % 900 + 100, e))
        .when(tool == "flake8", said("f.py:%d:1: %s said %d: more", n, pick(_FLAKE8, e % 4), e))
        .when(tool == "eslint", said('{"line":%d,"column":2,"severity":%d,"ruleId":"no-x","message":"%s %d"}', n, e % 2 + 1, pick(["uses eval", "plain"], e % 2), e))
        .when(tool == "jshint", said('{"line":%d,"code":"%s","reason":"missing %d"}', n, pick(["E001", "W033"], e % 2), e))
        .when(tool == "javac", said("Main.java:%d: %s %d", n, pick(_JAVAC, e % 3), e))
        .when(tool == "php", said("PHP Parse error:  syntax error, unexpected x%d in f.php on line %d", e, n))
        .when(tool == "ruby", said("f.rb:%d: syntax error, unexpected x%d", n, e))
        .when(tool == "go", said("./f.go:%d:2: %s %d", n, pick(_GO, e % 3), e))
        .otherwise("f.go")
    )


def _exit(tool: Column, file_id: Column) -> Column:
    out = F.when(tool.isNull(), None)
    for name, codes in _EXITS.items():
        out = out.when(tool == name, F.element_at(F.array(*[F.lit(c) for c in codes]), (file_id % len(codes) + 1).cast("int")))
    return out.otherwise(0)


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 6 = 0").select("event_id", F.col("user_id").alias("file_id"))
    e, turn = F.col("event_id"), (F.col("event_id") / 6).cast("bigint") % 2
    tools = spark.createDataFrame([(x, i, t) for x, names in TOOLS.items() for i, t in enumerate(names)], "language string, turn bigint, tool string")
    df = events.withColumns({"language": language_of(F.col("file_id")), "turn": turn}).join(F.broadcast(tools), ["language", "turn"])
    df = df.withColumn("text", _text(F.col("tool"), e, e % 200 + 1))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda x: x["text"])
    runs = df.groupBy("file_id", "language", "tool").agg(texts.alias("t"))
    raw = (
        F.when(F.col("tool") == "eslint", F.concat(F.lit('[{"messages":['), F.array_join("t", ","), F.lit("]}]")))
        .when(F.col("tool") == "jshint", F.concat(F.lit('[{"errors":['), F.array_join("t", ","), F.lit("]}]")))
        .otherwise(F.array_join("t", "\n"))
    )
    errs = F.col("tool").isin("javac", "php", "ruby", "go")
    return runs.select(
        "file_id", "language", "tool", _exit(F.col("tool"), F.col("file_id")).cast("int").alias("exit_code"), F.when(~errs, raw).otherwise("").alias("stdout"), F.when(errs, raw).otherwise("").alias("stderr")
    )


def _sql_pick(values: list, index: str) -> str:
    return f"{sql_list(values) if isinstance(values[0], str) else values}[1 + ({index})]"


_SQL_TOOL = "CASE " + " ".join(f"WHEN language = {quoted(x)} THEN {_sql_pick(names, 'e // 6 % 2')}" for x, names in TOOLS.items()) + " END"
_SQL_EXIT = "CASE " + " ".join(f"WHEN tool = {quoted(t)} THEN {_sql_pick(codes, f'file_id % {len(codes)}')}" for t, codes in _EXITS.items()) + " ELSE 0 END"
#: What the parsers are to find, made from the events and not from the text: items(file_id, tool, line, severity, message).
ITEMS_SQL = f"""ran AS (SELECT *, {_SQL_EXIT} AS code FROM (SELECT *, e % 200 + 1 AS n, {_SQL_TOOL} AS tool FROM (SELECT event_id AS e, user_id AS file_id,
    {sql_list(dims.LANGUAGES)}[1 + user_id % {len(dims.LANGUAGES)}] AS language FROM events WHERE event_id % 6 = 0))),
items AS (
  SELECT file_id, language, tool, n AS line, {_sql_pick(['error', 'warning', 'info', 'info', 'error'], 'e % 5')} AS severity, 'message: ' || e AS message FROM ran WHERE tool = 'pylint' AND code IN (0, 4, 8, 16, 28)
  UNION ALL SELECT file_id, language, tool, n, {_sql_pick(['warning', 'error', 'warning', 'error'], 'e % 4')}, 'said ' || e FROM ran WHERE tool = 'flake8'
  UNION ALL SELECT file_id, language, tool, n, CASE WHEN e % 2 = 1 THEN 'error' ELSE 'warning' END, {_sql_pick(['uses eval', 'plain'], 'e % 2')} || ' ' || e FROM ran WHERE tool = 'eslint' AND code IN (0, 1)
  UNION ALL SELECT file_id, language, tool, n, CASE WHEN e % 2 = 0 THEN 'error' ELSE 'warning' END, 'missing ' || e FROM ran WHERE tool = 'jshint'
  UNION ALL SELECT file_id, any_value(language), tool, 1, 'error', arg_min('Main.java:' || n || ': ' || {_sql_pick(_JAVAC, 'e % 3')} || ' ' || e, e) FROM ran WHERE tool = 'javac' AND code <> 0 GROUP BY file_id, tool
  UNION ALL SELECT file_id, language, tool, 1, 'warning', 'Main.java:' || n || ': ' || {quoted(_JAVAC[1])} || ' ' || e FROM ran WHERE tool = 'javac' AND code = 0 AND e % 3 = 1
  UNION ALL SELECT file_id, language, tool, n, 'error', 'syntax error, unexpected x' || e || ' in f.php on line ' || n FROM ran WHERE tool = 'php' AND code <> 0
  UNION ALL SELECT file_id, language, tool, n, 'error', 'f.rb:' || n || ': syntax error, unexpected x' || e FROM ran WHERE tool = 'ruby' AND code <> 0
  UNION ALL SELECT DISTINCT file_id, language, tool, 1, 'warning', 'Code not formatted with gofmt' FROM ran WHERE tool = 'gofmt'
  UNION ALL SELECT file_id, language, tool, n, CASE WHEN e % 3 = 0 THEN 'error' ELSE 'warning' END, '2: ' || {_sql_pick(_GO, 'e % 3')} || ' ' || e FROM ran WHERE tool = 'go' AND code <> 0)"""


_SCANNERS = {"python": "bandit", "javascript": "eslint", "go": "go_vet"}
_VET = ["insecure mode", "fatal: stop", "unused x"]
_ISSUES = ["Use of exec detected.", "Possible SQL injection vector", "Weak hash md5"]
_GRADES = ["LOW", "Medium", "HIGH"]


def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of security scanners, in the columns of tool_runs; exit code 2 on every fifth file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 40 = 0").select("event_id", F.col("user_id").alias("file_id"))
    e, n = F.col("event_id"), F.col("event_id") % 200 + 1
    df = events.withColumn("language", language_of(F.col("file_id")))
    tools = F.when(F.lit(False), None)
    for x, name in _SCANNERS.items():
        tools = tools.when(F.col("language") == x, name)
    df = df.withColumn("tool", tools).filter("tool is not null")
    turn = (e / 40).cast("bigint") % 3
    text = (
        F.when(F.col("tool") == "bandit", F.format_string('{"line_number":%d,"issue_severity":"%s","test_id":"B%d","issue_text":"%s","code":"c%d"}', n, pick(_GRADES, turn), e % 900, pick(_ISSUES, turn), e))
        .when(F.col("tool") == "eslint", F.format_string('{"line":%d,"severity":%d,"ruleId":"no-x","message":"%s %d"}', n, turn % 2 + 1, pick(["uses eval", "plain", "odd"], turn), e))
        .otherwise(F.format_string("f.go:%d:3: %s %d", n, pick(_VET, turn), e))
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))), lambda x: x["text"])
    runs = df.groupBy("file_id", "language", "tool").agg(texts.alias("t"))
    out = F.when(F.col("tool") == "bandit", F.concat(F.lit('{"results":['), F.array_join("t", ","), F.lit("]}"))).when(F.col("tool") == "eslint", F.concat(F.lit('[{"messages":['), F.array_join("t", ","), F.lit("]}]")))
    code = F.when(F.col("file_id") % 5 == 0, 2).otherwise(1)
    return runs.select("file_id", "language", "tool", code.alias("exit_code"), F.coalesce(out, F.lit("")).alias("stdout"), F.when(F.col("tool") == "go_vet", F.array_join("t", "\n")).otherwise("").alias("stderr"))


#: What the scanners' parsers are to find: scanned(file_id, tool, line, severity, description, ord).
SCANNED_SQL = f"""scanned AS (SELECT file_id, tool, n AS line, row_number() OVER (PARTITION BY file_id ORDER BY e) - 1 AS ord,
    CASE tool WHEN 'bandit' THEN upper({_sql_pick(_GRADES, 't')}) WHEN 'eslint' THEN CASE WHEN t = 0 THEN 'CRITICAL' WHEN t % 2 = 1 THEN 'HIGH' ELSE 'MEDIUM' END ELSE {_sql_pick(['HIGH', 'CRITICAL', 'MEDIUM'], 't')} END AS severity,
    CASE tool WHEN 'bandit' THEN {_sql_pick(_ISSUES, 't')} WHEN 'eslint' THEN {_sql_pick(['uses eval', 'plain', 'odd'], 't')} || ' ' || e ELSE {_sql_pick(_VET, 't')} || ' ' || e END AS description
  FROM (SELECT event_id AS e, user_id AS file_id, event_id % 200 + 1 AS n, event_id // 40 % 3 AS t,
    CASE {sql_list(dims.LANGUAGES)}[1 + user_id % {len(dims.LANGUAGES)}] {" ".join(f"WHEN {quoted(x)} THEN {quoted(t)}" for x, t in _SCANNERS.items())} END AS tool FROM events WHERE event_id % 40 = 0)
  WHERE tool = 'go_vet' OR (tool IS NOT NULL AND file_id % 5 <> 0))"""
