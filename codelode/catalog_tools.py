"""Queries over the output of external linters and scanners, and their SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import FOUND_SQL, LINES_SQL, SCORES_SQL, WARN_SQL, _report_sql, query
from .operators import lint, outcomes, scan
from .plans import review
from .sources import corpus, tool_runs
from .sources.corpus import quoted
from .sources.tool_runs import ITEMS_SQL, SCANNED_SQL

ALL_ITEMS_SQL = f"{LINES_SQL}, {WARN_SQL}, {ITEMS_SQL}, every AS (SELECT file_id, tool, line, severity, message FROM items UNION ALL SELECT file_id, 'manual', line, 'warning', message FROM warned)"
TOOL_LINT_SQL = f"""{ALL_ITEMS_SQL}, sums AS (SELECT f.file_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos
  FROM (SELECT DISTINCT file_id FROM lines) f LEFT JOIN every USING (file_id) GROUP BY f.file_id),
lint AS (SELECT *, CASE WHEN errors = 0 AND warnings = 0 THEN least(100, base + 10) ELSE base END::INT AS score, errors = 0 AS passed, errors + warnings AS complexity
  FROM (SELECT *, greatest(0, 100 - least(errors * 15, 70) - least(warnings * 5, 25) - least(infos * 2, 5)) AS base FROM sums))"""
TOOL_FOUND_SQL = f"""{FOUND_SQL}, {SCANNED_SQL}, both_found AS (SELECT file_id, line, 0 AS late, phase, ord, severity, description, 'regex' AS tool FROM found UNION ALL SELECT file_id, line, 1, 'tool', ord, severity, description, tool FROM scanned),
tooled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line, description ORDER BY late, phase, ord) AS rn FROM both_found) WHERE rn = 1),
tsums AS (SELECT file_id, count(*) AS n, sum(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 5 END) AS w, min(list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity)) AS top FROM tooled GROUP BY file_id),
tscores AS (SELECT file_id, coalesce(n, 0)::BIGINT AS findings, coalesce(w, 0)::BIGINT AS weight, (CASE WHEN coalesce(w, 0) <= 30 THEN 100 - coalesce(w, 0) ELSE greatest(70 - (w - 30) * 2, 0) END)::INT AS score,
  CASE WHEN n IS NULL THEN 'LOW' WHEN top = 1 OR w >= 40 THEN 'CRITICAL' WHEN top = 2 OR w >= 20 THEN 'HIGH' WHEN top = 3 OR w >= 10 THEN 'MEDIUM' WHEN top = 4 OR w >= 5 THEN 'LOW' ELSE 'INFO' END AS risk_level
  FROM (SELECT DISTINCT file_id FROM lines) LEFT JOIN tsums USING (file_id)),
used AS (SELECT file_id, any_value(tool) AS tool FROM scanned GROUP BY file_id)"""


_USED = "coalesce(s.tool, 'Regex scanner only')"


@query("tool_items", f"WITH {ITEMS_SQL} SELECT file_id, tool, line::INT AS line, severity, message FROM items")
def tool_items(spark, d):
    return lint.tool_items(tool_runs.tool_runs(spark, d))


@query("lint_with_tools", f"WITH {TOOL_LINT_SQL} SELECT file_id, errors, warnings, infos, score, passed, complexity FROM lint")
def lint_with_tools(spark, d):
    return lint.lint_results(corpus.lines(spark, d), tool_runs.tool_runs(spark, d))


@query(
    "lint_listed",
    f"""WITH {ALL_ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id, severity ORDER BY tool, line, message) AS rank FROM every)
    SELECT file_id, tool, line::BIGINT AS line, severity, message, rank::INT AS rank FROM r WHERE rank <= CASE severity WHEN 'info' THEN 20 ELSE 50 END""",
)
def lint_listed(spark, d):
    found = lint.listed(lint.items(corpus.lines(spark, d), tool_runs.tool_runs(spark, d)))
    return found.withColumn("line", F.col("line").cast("bigint"))


@query(
    "lint_by_tool",
    f"WITH {ALL_ITEMS_SQL} SELECT tool, severity, count(*) AS n FROM every GROUP BY ALL",
)
def lint_by_tool(spark, d):
    return lint.items(corpus.lines(spark, d), tool_runs.tool_runs(spark, d)).groupBy("tool", "severity").agg(F.count("*").alias("n"))


@query(
    "summary_with_tools",
    f"""WITH {TOOL_LINT_SQL} SELECT count(*) AS total_files, count(*) FILTER (passed) AS passed_files, sum(errors)::BIGINT AS total_errors, sum(warnings)::BIGINT AS total_warnings, sum(infos)::BIGINT AS total_infos,
      round(avg(score), 2) AS average_score, count(*) - count(*) FILTER (passed) AS failed_files,
      CASE WHEN sum(errors) = 0 AND sum(warnings) = 0 THEN 'excellent' WHEN sum(errors) = 0 THEN 'good' WHEN bool_and(passed) THEN 'acceptable' ELSE 'needs_improvement' END AS overall_status, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 2) AS pass_rate FROM lint""",
)
def summary_with_tools(spark, d):
    return review.style_summary(lint_with_tools(spark, d))


_TOOLS = [(x, i, t, s) for x, own in outcomes.EXPECTED.items() for i, (t, s) in enumerate(own.items())]
OUTCOMES_SQL = f"""{LINES_SQL}, {WARN_SQL}, {ITEMS_SQL}, tools(language, place, tool, seconds) AS (VALUES {", ".join(f"({quoted(x)}, {i}, {quoted(t)}, {s})" for x, i, t, s in _TOOLS)}),
file AS (SELECT DISTINCT file_id, language FROM lines),
one AS (SELECT file_id, tool, any_value(code) AS code FROM ran WHERE file_id % 7 <> 3 GROUP BY ALL),
outcome AS (SELECT f.file_id, t.tool, t.place, t.seconds, CASE WHEN o.tool IS NULL THEN 'missing' WHEN f.file_id % 9 = 4 AND t.tool <> 'flake8' THEN 'late'
    WHEN (t.tool = 'pylint' AND code NOT IN (0, 4, 8, 16, 28)) OR (t.tool = 'eslint' AND code NOT IN (0, 1)) THEN 'bad_exit' WHEN t.tool = 'jshint' AND f.file_id % 5 = 1 THEN 'unreadable' ELSE 'ran' END AS outcome
  FROM file f JOIN tools t USING (language) LEFT JOIN one o ON o.file_id = f.file_id AND o.tool = t.tool)"""
_WHY_SQL = "CASE outcome WHEN 'missing' THEN '[Errno 2] No such file or directory: ''' || tool || '''' ELSE 'timed out after ' || seconds || ' seconds' END"


def _troubled_runs(spark, d):
    """Runs of which some were not started, some stopped at their limit, and some printed no JSON."""
    late = (F.col("file_id") % 9 == 4) & (F.col("tool") != "flake8")
    odd = (F.col("tool") == "jshint") & (F.col("file_id") % 5 == 1)
    runs = tool_runs.tool_runs(spark, d).filter("file_id % 7 <> 3")
    return runs.withColumns({"exit_code": F.when(~late, F.col("exit_code")), "stdout": F.when(odd, "no JSON").otherwise(F.col("stdout"))})


@query("tool_outcomes", f"WITH {OUTCOMES_SQL} SELECT file_id, tool, outcome FROM outcome")
def tool_outcomes(spark, d):
    files = corpus.lines(spark, d).select("file_id", "language").distinct()
    return outcomes.outcomes(files, _troubled_runs(spark, d)).select("file_id", "tool", "outcome")


@query(
    "lint_with_failures",
    f"""WITH {OUTCOMES_SQL},
    every AS (SELECT file_id, severity FROM items JOIN outcome o USING (file_id, tool) WHERE o.outcome = 'ran' UNION ALL SELECT file_id, 'warning' FROM warned
      UNION ALL SELECT file_id, 'warning' FROM outcome WHERE outcome IN ('missing', 'late') AND tool IN ('pylint', 'flake8', 'eslint')),
    broke AS (SELECT file_id, arg_min(CASE outcome WHEN 'late' THEN 'Linter timeout - code too complex' ELSE 'Linter failed: ' || {_WHY_SQL} END, place) AS error FROM outcome
      WHERE outcome IN ('missing', 'late') AND tool NOT IN ('pylint', 'flake8', 'eslint', 'jshint') GROUP BY file_id),
    sums AS (SELECT f.file_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i
      FROM file f LEFT JOIN every USING (file_id) GROUP BY f.file_id)
    SELECT file_id, error, CASE WHEN error IS NULL THEN e ELSE 1 END::BIGINT AS errors, CASE WHEN error IS NULL THEN w ELSE 0 END::BIGINT AS warnings, CASE WHEN error IS NULL THEN i ELSE 0 END::BIGINT AS infos,
      CASE WHEN error IS NOT NULL THEN 0 WHEN e = 0 AND w = 0 THEN least(100, 110 - least(i * 2, 5)) ELSE greatest(0, 100 - least(e * 15, 70) - least(w * 5, 25) - least(i * 2, 5)) END::INT AS score,
      error IS NULL AND e = 0 AS passed, CASE WHEN error IS NULL THEN e + w ELSE 0 END::BIGINT AS complexity FROM sums LEFT JOIN broke USING (file_id)""",
)
def lint_with_failures(spark, d):
    return outcomes.lint_results(corpus.lines(spark, d), _troubled_runs(spark, d))


@query("failure_items", f"WITH {OUTCOMES_SQL} SELECT file_id, tool, CASE tool WHEN 'eslint' THEN 'ESLint' ELSE tool END || ' failed: ' || {_WHY_SQL} AS message FROM outcome WHERE outcome IN ('missing', 'late') AND tool IN ('pylint', 'flake8', 'eslint')")
def failure_items(spark, d):
    files = corpus.lines(spark, d).select("file_id", "language").distinct()
    return outcomes.failure_items(outcomes.outcomes(files, _troubled_runs(spark, d))).select("file_id", "tool", "message")


@query(
    "security_with_failures",
    f"""WITH {SCORES_SQL}, f AS (SELECT DISTINCT file_id, CASE WHEN file_id % 8 = 5 THEN 'shell' ELSE language END AS language FROM lines)
    SELECT s.file_id, CASE WHEN x THEN 0 ELSE findings END AS findings, CASE WHEN x THEN 0 ELSE weight END AS weight, CASE WHEN other THEN 100 WHEN broke THEN 0 ELSE score END AS score,
      CASE WHEN other THEN 'LOW' WHEN broke THEN 'HIGH' ELSE risk_level END AS risk_level, other OR (NOT broke AND risk_level IN ('LOW', 'INFO')) AS passed,
      CASE WHEN other THEN 'Unsupported language for security scan: shell' WHEN broke THEN 'Security scan failed: stopped ' || s.file_id END AS error
    FROM (SELECT *, file_id % 8 = 5 AS other, file_id % 6 = 1 AS broke, file_id % 8 = 5 OR file_id % 6 = 1 AS x FROM scores) s JOIN f USING (file_id)""",
)
def security_with_failures(spark, d):
    lines = corpus.lines(spark, d)
    files = lines.select("file_id", F.when(F.col("file_id") % 8 == 5, "shell").otherwise(F.col("language")).alias("language")).distinct()
    failed = files.filter("file_id % 6 = 1").select("file_id", F.format_string("stopped %d", "file_id").alias("error"))
    return scan.scores_with_failures(files, scan.deduplicated(scan.findings(lines, scan.rules(spark))), failed)


@query("java_class_name", "SELECT doc_id, CASE WHEN regexp_matches(text, 'class\\s+\\w+') THEN regexp_extract(text, 'class\\s+(\\w+)', 1) ELSE 'TempClass' END AS class_name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'public class Doc' || doc_id || ' {' ELSE 'interface x' END AS text FROM documents)")
def java_class_name(spark, d):
    code = F.when(F.col("doc_id") % 2 == 0, F.format_string("public class Doc%d {", "doc_id")).otherwise("interface x")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", lint.java_class_name(code).alias("class_name"))


@query("scanner_findings", f"WITH {SCANNED_SQL} SELECT file_id, tool, line, severity, description FROM scanned")
def scanner_findings(spark, d):
    return scan.tool_findings(tool_runs.scan_runs(spark, d)).select("file_id", "tool", "line", "severity", "description")


@query("security_with_tools", f"WITH {TOOL_FOUND_SQL} SELECT file_id, findings, weight, score, risk_level, risk_level IN ('LOW', 'INFO') AS passed FROM tscores")
def security_with_tools(spark, d):
    lines = corpus.lines(spark, d)
    return scan.scores(lines.select("file_id").distinct(), scan.all_findings(lines, tool_runs.scan_runs(spark, d)))


@query("tools_used", f"WITH {LINES_SQL}, {SCANNED_SQL} SELECT f.file_id, coalesce(any_value(tool), 'regex') AS tools FROM (SELECT DISTINCT file_id FROM lines) f LEFT JOIN scanned USING (file_id) GROUP BY f.file_id")
def tools_used(spark, d):
    used = scan.tools_used(corpus.lines(spark, d).select("file_id").distinct(), tool_runs.scan_runs(spark, d))
    return used.select("file_id", F.array_join("tools", ",").alias("tools"))


@query("security_report_with_tools", f"WITH {TOOL_FOUND_SQL}, {_report_sql('tooled', '(SELECT * FROM tscores LEFT JOIN used USING (file_id))', _USED)}")
def security_report_with_tools(spark, d):
    lines, runs = corpus.lines(spark, d), tool_runs.scan_runs(spark, d)
    files = lines.select("file_id").distinct()
    return scan.report(files, scan.all_findings(lines, runs), scan.tools_used(files, runs))
