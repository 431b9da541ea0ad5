"""A synthetic code corpus from the events table, the same in Spark and in SQL.

file_id = user_id; line = row number by event_id; language by file; text = one of TEMPLATES by event and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims

TEMPLATES = [
    "import os",
    "def run(cmd):",
    "    os.system('ls ' + cmd)",
    "cursor.execute('select * from t where id=' + uid)",
    "password = 'hunter2x'",
    "x = eval(data)",
    "element.innerHTML = name;",
    "document.write('<b>' + name);",
    "var total = 0;",
    "if (a == b) { return; }",
    "// var legacy",
    "shell_exec($x);",
    "<?php echo $name; ?>",
    "<? print $name; ?>",
    "ObjectInputStream s = readObject(i);",
    "public class Main { import java.util.*; }",
    "import java.util.*;",
    "random.randint(1, 6)",
    "exec.Command(name)",
    "SecurityManager manager;",
    "// TODO fix security later",
    "if ready then puts 1",
    "rand(10)",
    "crypto/md5",
    "def value = compute(a, b)",
    "",
    "# comment only",
    "total = total + 1",
    "console.log(total)",
    "a_line_that_is_meant_to_be_much_too_long = first_argument_of_the_call + second_argument_of_the_call + third_argument_of_it",
]
ENDINGS = [".py", ".java", ".js", ".php", ".rb", ".go", ".cs", ".cpp", ""]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def language_of(file_id: Column) -> Column:
    return pick(dims.LANGUAGES, file_id % len(dims.LANGUAGES))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, line, language, text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("file_id"))
    line = F.row_number().over(W.partitionBy("file_id").orderBy("event_id"))
    text = pick(TEMPLATES, (F.col("event_id") * 7 + F.col("file_id")) % len(TEMPLATES))
    return events.select("file_id", line.alias("line"), language_of(F.col("file_id")).alias("language"), text.alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, filename, code: the lines of each file joined."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    code = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    out = lines(spark, sf_dir).groupBy("file_id").agg(code.alias("code"))
    name = F.concat(F.lit("src/f"), F.col("file_id").cast("string"), pick(ENDINGS, F.col("file_id") % len(ENDINGS)))
    return out.select("file_id", name.alias("filename"), "code")


#: Code of the nodes: sources, sanitizers, sinks and plain code of all languages.
CODES = [
    "x = input()", "os.system(x)", "html.escape(x)", "total = total + 1", "cursor.execute('select a' + x)", "el.innerHTML = x", "req.query.id", "document.write(x)",
    "encodeURIComponent(x)", "Scanner.nextLine()", "Runtime.exec (x)", "URLEncoder.encode(x)", "file_get_contents($f)", "echo $x", "htmlentities($x)", "gets",
    "system(x)", "CGI.escapeHTML(x)", "os.Getenv(k)", "fmt.Sprintf('SELECT 1', x)", "strconv.Quote(x)", "f(x)", "ok", "params[:id] ", "\"INSERT into t\" + x", "exec (cmd + \"DELETE \" + x)",
]


#: A source and a sink in each of the languages, in their order.
OWN_CODES = [
    ["x = input()", "os.system(x)"], ["Scanner.nextLine()", "Runtime.exec (x)"], ["req.query.id", "document.write(x)"], ["file_get_contents($f)", "echo $x"], ["gets", "system(x)"], ["os.Getenv(k)", "exec (x)"],
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes derived from events: ids in event order, three levels of 25, 5 and 1 nodes, types and code by event;
    every second piece of code is a source or a sink of the file's own language."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("file_id"))
    node = (F.row_number().over(W.partitionBy("file_id").orderBy("event_id")) - 1).cast("bigint")
    df = events.select("file_id", "event_id", node.alias("id"))
    kind = pick([t for _, t in dims.NODE_TYPES] + [dims.OTHER_NODE_TYPE], F.col("event_id") % 17)
    above = F.array(F.lit(0).cast("bigint"), F.col("id") - F.col("id") % 25, F.col("id") - F.col("id") % 5)
    path = F.array_distinct(F.filter(above, lambda x: x < F.col("id")))
    last = F.max("id").over(W.partitionBy("file_id"))
    wide = F.when(F.col("id") == 0, last).when(F.col("id") % 25 == 0, F.col("id") + 24).when(F.col("id") % 5 == 0, F.col("id") + 4).otherwise(F.col("id"))
    own = F.array(*[F.array(*[F.lit(x) for x in pair]) for pair in OWN_CODES])
    own = F.get(F.get(own, (F.col("file_id") % len(OWN_CODES)).cast("int")), (F.floor(F.col("event_id") / 2) % 2).cast("int"))
    code = F.when(F.col("event_id") % 2 == 0, own).otherwise(pick(CODES, (F.col("event_id") * 5 + F.col("file_id")) % len(CODES)))
    return df.select(
        "file_id", "id", F.get(path, F.size(path) - 1).alias("parent_id"), F.least(wide, last).alias("last_id"), F.size(path).alias("depth"),
        F.floor(F.col("id") / 2).cast("bigint").alias("line"), (F.col("event_id") % 5).alias("col"), kind.alias("node_type"),
        F.concat(F.lit("f"), (F.col("event_id") % 13).cast("string")).alias("name"), "event_id",
        code.alias("code"), language_of(F.col("file_id")).alias("language"), (F.col("event_id") % 19 == 0).alias("is_condition"),
    )


def var_refs(spark: SparkSession, sf_dir: str, variables: int = 11, defined: tuple[int, ...] = (0,)) -> DataFrame:
    """file_id, id, var, kind: one definition or use at each node; a definition where event_id % 3 is among defined."""
    n = nodes(spark, sf_dir)
    kind = F.when((F.col("event_id") % 3).isin(*defined), "def").otherwise("use")
    return n.select("file_id", "id", F.concat(F.lit("v"), (F.col("event_id") % variables).cast("string")).alias("var"), kind.alias("kind"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


LINES_SQL = f"""lines AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line,
    {sql_list(dims.LANGUAGES)}[1 + user_id % {len(dims.LANGUAGES)}] AS language,
    {sql_list(TEMPLATES)}[1 + (event_id * 7 + user_id) % {len(TEMPLATES)}] AS text
  FROM events)"""
FILES_SQL = LINES_SQL + f""", files AS (
  SELECT file_id, 'src/f' || file_id || {sql_list(ENDINGS)}[1 + file_id % {len(ENDINGS)}] AS filename,
    string_agg(text, chr(10) ORDER BY line) AS code
  FROM lines GROUP BY file_id)"""
NODES_SQL = f"""nodes AS (
  SELECT file_id, id, CASE WHEN id = 0 THEN NULL WHEN id % 25 = 0 THEN 0 WHEN id % 5 = 0 THEN id - id % 25 ELSE id - id % 5 END AS parent_id, id // 2 AS line, event_id % 5 AS col,
    {sql_list([t for _, t in dims.NODE_TYPES] + [dims.OTHER_NODE_TYPE])}[1 + event_id % 17] AS node_type, 'f' || (event_id % 13) AS name, event_id,
    CASE WHEN event_id % 2 = 0 THEN [{", ".join(map(sql_list, OWN_CODES))}][1 + file_id % {len(OWN_CODES)}][1 + event_id // 2 % 2] ELSE {sql_list(CODES)}[1 + (event_id * 5 + file_id) % {len(CODES)}] END AS code, {sql_list(dims.LANGUAGES)}[1 + file_id % {len(dims.LANGUAGES)}] AS language, event_id % 19 = 0 AS is_condition
  FROM (SELECT user_id AS file_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS id FROM events)),
refs AS (SELECT file_id, id, 'v' || (event_id % 11) AS var, CASE WHEN event_id % 3 = 0 THEN 'def' ELSE 'use' END AS kind FROM nodes)"""
RULES_SQL = "rules(ord, language, phase, severity, description, regex) AS (VALUES " + ", ".join(
    f"({i}, {quoted(lang)}, {quoted(phase)}, {quoted(sev)}, {quoted(desc)}, {quoted(rx)})" for i, (lang, phase, sev, desc, rx) in enumerate(dims.RULES)
) + ")"
