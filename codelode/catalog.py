"""Registry of the queries of the review analytics and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dims, ladders
from .operators import detect, flows, graph, lint, merges, rule_index, scan
from .plans import review
from .sources import corpus, readers
from .sources.corpus import FILES_SQL, LINES_SQL, NODES_SQL, RULES_SQL, quoted, sql_list

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_ladder(column: str, rungs: list, otherwise: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({column}), {quoted(w)})" for w in words) + f" THEN {quoted(v)}" for words, v in rungs)
    return f"CASE {whens} ELSE {otherwise} END"


FOUND_SQL = f"""{LINES_SQL}, {RULES_SQL}, found AS (
  SELECT file_id, line, l.language, ord, phase, severity, description, text, regex
  FROM lines l JOIN rules r ON l.language = r.language AND regexp_matches(text, '(?i)' || regex)),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line, description ORDER BY phase, ord) AS rn FROM found) WHERE rn = 1)"""
SCORES_SQL = FOUND_SQL + """, sums AS (
  SELECT file_id, count(*) AS findings,
    sum(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 5 END) AS weight,
    bool_or(severity = 'CRITICAL') AS c, bool_or(severity = 'HIGH') AS h, bool_or(severity = 'MEDIUM') AS m, bool_or(severity = 'LOW') AS l,
    count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS grave
  FROM dedup GROUP BY file_id),
scores AS (
  SELECT f.file_id, coalesce(findings, 0)::BIGINT AS findings, coalesce(weight, 0)::BIGINT AS weight, coalesce(grave, 0) AS grave,
    (CASE WHEN coalesce(weight, 0) <= 30 THEN 100 - coalesce(weight, 0) ELSE greatest(70 - (weight - 30) * 2, 0) END)::INT AS score,
    CASE WHEN findings IS NULL THEN 'LOW' WHEN c OR weight >= 40 THEN 'CRITICAL' WHEN h OR weight >= 20 THEN 'HIGH'
      WHEN m OR weight >= 10 THEN 'MEDIUM' WHEN l OR weight >= 5 THEN 'LOW' ELSE 'INFO' END AS risk_level
  FROM (SELECT DISTINCT file_id FROM lines) f LEFT JOIN sums USING (file_id))"""
WARN_SQL = """warned AS (
  SELECT file_id, line, language, 0 AS ord, 'Use ''let'' or ''const'' instead of ''var''' AS message FROM lines
    WHERE language = 'javascript' AND regexp_matches(text, '\\bvar\\s+\\w+') AND NOT contains(split_part(text, 'var', 1), '//')
  UNION ALL SELECT file_id, line, language, 1, 'Use ''==='' or ''!=='' for strict equality' FROM lines
    WHERE language = 'javascript' AND (contains(text, ' == ') OR contains(text, ' != ')) AND NOT contains(text, '//')
  UNION ALL SELECT file_id, line, language, 2, 'Use full PHP opening tag <?php instead of <?' FROM lines
    WHERE language = 'php' AND contains(text, '<? ') AND NOT contains(text, '<?php')
  UNION ALL SELECT file_id, line, language, 3, 'Avoid using ''then'' in if statements' FROM lines
    WHERE language = 'ruby' AND starts_with(trim(text), 'if ') AND contains(text, 'then')
  UNION ALL SELECT file_id, line, language, 4, 'Line too long (' || length(text) || ' > ' || n || ')' FROM
    (SELECT *, CASE WHEN language IN ('javascript', 'ruby', 'go') THEN 100 WHEN language IN ('java', 'php') THEN 120 END AS n FROM lines) WHERE length(text) > n
  UNION ALL SELECT file_id, line, language, 5, 'Avoid wildcard imports' FROM lines
    WHERE language = 'java' AND starts_with(trim(text), 'import') AND contains(text, '.*;'))"""
LINT_SQL = WARN_SQL + """, lint AS (
  SELECT file_id, 0::BIGINT AS errors, count(w.file_id) AS warnings, 0::BIGINT AS infos,
    (CASE WHEN count(w.file_id) = 0 THEN 100 ELSE 100 - least(count(w.file_id) * 5, 25) END)::INT AS score, true AS passed, count(w.file_id) AS complexity
  FROM (SELECT DISTINCT file_id FROM lines) f LEFT JOIN (SELECT file_id FROM warned) w USING (file_id) GROUP BY file_id)"""


# --- lines and files


@query("lines_explode", "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line, unnest(string_split(text, chr(10))) AS text FROM documents")
def lines_explode(spark, d):
    parts = F.posexplode(F.split("text", "\n", -1)).alias("pos", "part")
    return _table(spark, d, "documents").select("doc_id", parts).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("part").alias("text"))


@query(
    "loc_by_language",
    f"""WITH {LINES_SQL}, s AS (SELECT *, last_value(CASE WHEN contains(text, '?>') THEN 0 WHEN contains(text, '<?php') OR contains(text, '<?=') THEN 1 END IGNORE NULLS)
      OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM lines)
    SELECT file_id, language, count(*) FILTER (trim(text) <> '' AND NOT starts_with(trim(text), CASE WHEN language IN ('python', 'ruby') THEN '#' ELSE '//' END)
      AND (language <> 'php' OR coalesce(inside, 0) = 1)) AS loc FROM s GROUP BY file_id, language""",
)
def loc_by_language(spark, d):
    return lint.lines_of_code(corpus.lines(spark, d))


@query("manual_line_rules", f"WITH {LINES_SQL}, {WARN_SQL} SELECT file_id, line, message FROM warned")
def manual_line_rules(spark, d):
    return lint.line_warnings(corpus.lines(spark, d)).select("file_id", "line", "message")


@query("lint_score", f"WITH {LINES_SQL}, {LINT_SQL} SELECT * FROM lint")
def lint_score(spark, d):
    return lint.lint_results(corpus.lines(spark, d))


_PYLINT = "'f.py:' || event_id || ':' || (event_id % 80) || ': ' || ['E', 'W', 'C', 'R', 'F'][1 + event_id % 5] || '0' || (100 + event_id % 900) || ': message ' || user_id"


@query(
    "pylint_parse",
    f"""SELECT event_id, event_id::INT AS line, (event_id % 80)::INT AS col, ['E', 'W', 'C', 'R', 'F'][1 + event_id % 5] || '0' || (100 + event_id % 900) AS code,
      'message ' || user_id AS message, ['error', 'warning', 'info', 'info', 'error'][1 + event_id % 5] AS severity FROM events""",
)
def pylint_parse(spark, d):
    letter = corpus.pick(["E", "W", "C", "R", "F"], F.col("event_id") % 5)
    raw = F.concat(F.lit("f.py:"), "event_id", F.lit(":"), F.col("event_id") % 80, F.lit(": "), letter, F.lit("0"), F.col("event_id") % 900 + 100, F.lit(": message "), "user_id")
    return _table(spark, d, "events").select("event_id", lint.parse_pylint(raw).alias("p")).select("event_id", "p.*")


@query(
    "flake8_parse",
    """SELECT event_id, event_id::INT AS line, ['E501', 'F821', 'W291', 'E999'][1 + event_id % 4] AS code, 'said ' || user_id AS message,
      ['warning', 'error', 'warning', 'error'][1 + event_id % 4] AS severity FROM events""",
)
def flake8_parse(spark, d):
    code = corpus.pick(["E501", "F821", "W291", "E999"], F.col("event_id") % 4)
    raw = F.concat(F.lit("f.py:"), "event_id", F.lit(":1: "), code, F.lit(" said "), "user_id")
    return _table(spark, d, "events").select("event_id", lint.parse_flake8(raw).alias("p")).select("event_id", "p.*")


@query(
    "govet_parse",
    "SELECT event_id, event_id::INT AS line, ['unsafe pointer', 'fatal: stop', 'unused x'][1 + event_id % 3] AS message, ['HIGH', 'CRITICAL', 'MEDIUM'][1 + event_id % 3] AS severity FROM events",
)
def govet_parse(spark, d):
    said = corpus.pick(["unsafe pointer", "fatal: stop", "unused x"], F.col("event_id") % 3)
    raw = F.concat(F.lit("f.go:"), "event_id", F.lit(":3: "), said)
    return _table(spark, d, "events").select("event_id", lint.parse_govet(raw).alias("p")).select("event_id", "p.*")


@query(
    "eslint_json_parse",
    """SELECT event_id, event_id::INT AS line, 'no-x' AS rule, CASE WHEN event_id % 3 = 0 THEN 'CRITICAL' WHEN event_id % 2 = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
      CASE WHEN event_id % 3 = 0 THEN 'uses eval' ELSE 'plain' END AS message FROM events""",
)
def eslint_json_parse(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, "uses eval").otherwise("plain")
    raw = F.format_string('[{"messages":[{"line":%d,"ruleId":"no-x","severity":%d,"message":"%s"}]}]', F.col("event_id"), F.col("event_id") % 2 + 1, said)
    return _table(spark, d, "events").select("event_id", F.explode(lint.parse_eslint(raw)).alias("m")).select("event_id", "m.*")


@query("json_input_files", "SELECT 'c' || conv_id || '_' || turn || '.py' AS filename, length(text) AS code_length FROM conversations")
def json_input_files(spark, d):
    item = F.struct(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn", F.lit(".py")).alias("filename"), F.col("text").alias("code"))
    packed = _table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(item)).alias("j"))
    files = readers.json_files(packed.withColumnRenamed("j", "value"))
    return files.select("filename", F.length("code").cast("bigint").alias("code_length"))


# --- detection


def _ext_sql() -> str:
    return "CASE WHEN ends_with(lower(filename), '.cs') THEN NULL " + " ".join(
        f"WHEN {' OR '.join(f'ends_with(lower(filename), {quoted(e)})' for e in ends)} THEN {quoted(x)}" for x, ends in dims.EXTENSIONS.items()
    ) + " END"


_SCORE = {
    x: " + ".join(f"len(regexp_extract_all(code, {quoted('(?mi)' + p)})) * {w}" for lang, w, p in dims.LANGUAGE_PATTERNS if lang == x) for x in dims.LANGUAGES
}
_SHEBANG_SQL = "CASE " + " ".join(f"WHEN regexp_matches(first, {quoted('(?i)^#!.*' + chr(92) + 'b' + w)}) THEN {quoted(x)}" for w, x in dims.SHEBANGS) + " END"
DETECT_SQL = FILES_SQL + f""", head AS (SELECT file_id, filename, code AS whole, array_to_string(string_split(code, chr(10))[1:100], chr(10)) AS code,
    split_part(trim(code, chr(32) || chr(10)), chr(10), 1) AS first FROM files),
scored AS (SELECT *, [{", ".join(_SCORE[x] for x in dims.LANGUAGES)}] AS s, {_ext_sql()} AS ext, {_SHEBANG_SQL} AS bang FROM head),
content AS (SELECT file_id, filename, ext, CASE WHEN bang IS NOT NULL THEN bang WHEN length(trim(whole, chr(32) || chr(10))) >= 10 AND list_max(s) >= 2
      THEN {sql_list(dims.LANGUAGES)}[list_position(s, list_max(s))] END AS content_language,
    CASE WHEN bang IS NOT NULL THEN 0.95 WHEN length(trim(whole, chr(32) || chr(10))) >= 10 AND list_max(s) >= 2
      THEN least(1.0, list_max(s)::DOUBLE / greatest(10.0, list_sum(s)::DOUBLE / 3)) ELSE 0.0 END::DOUBLE AS content_confidence FROM scored),
det AS (SELECT file_id, CASE WHEN ends_with(lower(filename), '.cs') THEN NULL ELSE coalesce(ext, content_language) END AS language,
    CASE WHEN ends_with(lower(filename), '.cs') THEN 0.0 WHEN ext = content_language THEN greatest(0.9, content_confidence)
      WHEN ext IS NOT NULL AND content_language IS NOT NULL THEN 0.7 WHEN ext IS NOT NULL THEN 0.8 WHEN content_language IS NOT NULL THEN content_confidence ELSE 0.0 END::DOUBLE AS confidence FROM content)"""


@query("detect_extension", f"WITH {FILES_SQL} SELECT file_id, {_ext_sql()} AS language FROM files")
def detect_extension(spark, d):
    return corpus.files(spark, d).select("file_id", detect.by_extension(F.col("filename")).alias("language"))


@query("detect_content", f"WITH {DETECT_SQL} SELECT file_id, content_language AS language, round(content_confidence, 6) AS confidence FROM content")
def detect_content(spark, d):
    return detect.with_content(corpus.files(spark, d)).select("file_id", F.col("content_language").alias("language"), F.round("content_confidence", 6).alias("confidence"))


@query("detect_combined", f"WITH {DETECT_SQL} SELECT file_id, language, round(confidence, 6) AS confidence FROM det")
def detect_combined(spark, d):
    return detect.detected(corpus.files(spark, d)).select("file_id", "language", F.round("confidence", 6).alias("confidence"))


@query(
    "language_gate",
    f"""WITH {DETECT_SQL} SELECT file_id, CASE WHEN confidence < 0.7 OR language IS NULL OR language = 'shell' THEN 'UNSUPPORTED_LANGUAGE' ELSE 'SUPPORTED' END AS status,
      CASE WHEN confidence < 0.7 THEN 'Low confidence' WHEN language IS NULL OR language = 'shell' THEN 'Unsupported language' END AS reason FROM det""",
)
def language_gate(spark, d):
    return detect.gated(corpus.files(spark, d)).select("file_id", "status", "reason")


# --- security scan


@query("rule_findings", f"WITH {FOUND_SQL} SELECT file_id, line, ord, severity FROM found")
def rule_findings(spark, d):
    return scan.findings(corpus.lines(spark, d), scan.rules(spark)).select("file_id", "line", "ord", "severity")


_KEYS_SQL = "keys(ord, key) AS (VALUES " + ", ".join(f"({i}, {quoted(k)})" for i, k in enumerate(rule_index.keyed([(r[0], r[4]) for r in dims.RULES]))) + ")"


@query(
    "rule_tests",
    f"""WITH {LINES_SQL}, {RULES_SQL}, {_KEYS_SQL} SELECT l.language, count(*) AS line_rules, count(*) FILTER (contains(lower(text), key)) AS tested,
      count(*) FILTER (regexp_matches(text, '(?i)' || regex)) AS matched FROM lines l JOIN rules r ON l.language = r.language JOIN keys USING (ord) GROUP BY l.language""",
)
def rule_tests(spark, d):
    """Lines times rules of each language, the pairs left to test, and those that match."""
    lines, table = corpus.lines(spark, d), scan.rules(spark)
    every = lines.groupBy("language").agg(F.count("*").alias("n")).join(table.groupBy("language").agg(F.count("*").alias("r")), "language")
    pairs = rule_index.reached(lines, table).groupBy("language").agg(F.count("*").alias("tested"), F.count_if(F.expr("rlike(text, pattern)")).alias("matched"))
    return every.join(pairs, "language", "left").na.fill(0).select("language", (F.col("n") * F.col("r")).alias("line_rules"), "tested", "matched")


@query("findings_dedup", f"WITH {FOUND_SQL} SELECT file_id, line, description, severity, {_sql_ladder('description', dims.CATEGORIES, quoted(dims.OTHER_CATEGORY))} AS category FROM dedup")
def findings_dedup(spark, d):
    return _found(spark, d).select("file_id", "line", "description", "severity", "category")


def _found(spark, d):
    return scan.deduplicated(scan.findings(corpus.lines(spark, d), scan.rules(spark)))


@query("matched_text", f"WITH {FOUND_SQL} SELECT file_id, line, ord, substr(CASE WHEN phase = 'common' THEN regexp_extract(text, '(?i)' || regex) ELSE trim(text) END, 1, 100) AS matched_text FROM dedup")
def matched_text(spark, d):
    return _found(spark, d).select("file_id", "line", "ord", "matched_text")


@query(
    "rule_dimension",
    f"WITH {RULES_SQL} SELECT ord, {_sql_ladder('description', dims.CATEGORIES, quoted(dims.OTHER_CATEGORY))} AS category, {_sql_ladder('description', dims.REMEDIATIONS, quoted(dims.OTHER_REMEDIATION))} AS remediation FROM rules",
)
def rule_dimension(spark, d):
    return scan.rules(spark).select("ord", "category", "remediation")


@query("security_score", f"WITH {SCORES_SQL} SELECT file_id, findings, weight, score, risk_level, risk_level IN ('LOW', 'INFO') AS passed FROM scores")
def security_score(spark, d):
    lines = corpus.lines(spark, d)
    return scan.scores(lines.select("file_id").distinct(), scan.deduplicated(scan.findings(lines, scan.rules(spark))))


@query("summary_by_severity", f"WITH {FOUND_SQL} SELECT file_id, severity, count(*) AS n FROM dedup GROUP BY ALL")
def summary_by_severity(spark, d):
    return _found(spark, d).groupBy("file_id", "severity").agg(F.count("*").alias("n"))


@query("summary_by_category", f"WITH {FOUND_SQL}, c AS (SELECT file_id, {_sql_ladder('description', dims.CATEGORIES, quoted(dims.OTHER_CATEGORY))} AS category FROM dedup) SELECT file_id, category, count(*) AS n FROM c GROUP BY ALL")
def summary_by_category(spark, d):
    return _found(spark, d).groupBy("file_id", "category").agg(F.count("*").alias("n"))


_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regex, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


@query(
    "rule_ids",
    f"""WITH {FOUND_SQL}, ids AS (SELECT ord, CASE WHEN phase = 'lang' THEN upper(language) ELSE 'SEC' END || '_' || severity || '_' || lpad(({_CRC_SQL} % 10000)::VARCHAR, 4, '0') AS rule_id FROM rules)
    SELECT file_id, line, rule_id, confidence FROM dedup JOIN ids USING (ord) JOIN (SELECT ord, CASE WHEN {" OR ".join(f"(language = {quoted(x)} AND phase = {quoted(p)})" for x, p in dims.MEDIUM_CONFIDENCE)} THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM rules) USING (ord)""",
)
def rule_ids(spark, d):
    return _found(spark, d).select("file_id", "line", "rule_id", "confidence")


@query(
    "summary_maps",
    f"""WITH {FOUND_SQL}, c AS (SELECT *, {_sql_ladder('description', dims.CATEGORIES, quoted(dims.OTHER_CATEGORY))} AS category FROM dedup),
    s AS (SELECT file_id, '{{' || string_agg('"' || severity || '":' || n, ',' ORDER BY severity) || '}}' AS by_severity, sum(n)::BIGINT AS n FROM (SELECT file_id, severity, count(*) AS n FROM c GROUP BY ALL) GROUP BY file_id),
    k AS (SELECT file_id, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS by_category FROM (SELECT file_id, category, count(*) AS n FROM c GROUP BY ALL) GROUP BY file_id)
    SELECT f.file_id, coalesce(s.n, 0) AS total_findings, coalesce(by_severity, '{{}}') AS by_severity, coalesce(by_category, '{{}}') AS by_category FROM (SELECT DISTINCT file_id FROM lines) f LEFT JOIN s USING (file_id) LEFT JOIN k USING (file_id)""",
)
def summary_maps(spark, d):
    maps = scan.summary_maps(corpus.lines(spark, d), _found(spark, d))
    return maps.withColumns({c: F.to_json(c) for c in ("by_severity", "by_category")})


@query(
    "summary_advice",
    f"WITH {SCORES_SQL} SELECT file_id, CASE WHEN c THEN {quoted(dims.SUMMARY_ADVICE['CRITICAL'])} WHEN h THEN {quoted(dims.SUMMARY_ADVICE['HIGH'])} WHEN m THEN {quoted(dims.SUMMARY_ADVICE['MEDIUM'])} WHEN l THEN {quoted(dims.SUMMARY_ADVICE['LOW'])} ELSE {quoted(dims.SUMMARY_OTHER)} END AS recommendation FROM sums",
)
def summary_advice(spark, d):
    return scan.advice(_found(spark, d))


@query(
    "report_top10",
    f"WITH {FOUND_SQL}, r AS (SELECT file_id, severity, row_number() OVER (PARTITION BY file_id, severity ORDER BY line, ord)::INT AS rank, line, description FROM dedup) SELECT * FROM r WHERE rank <= 10",
)
def report_top10(spark, d):
    return scan.top_per_severity(_found(spark, d)).select("file_id", "severity", "rank", "line", "description")


def _report_sql(found: str, scores: str, tools: str) -> str:
    """The report text out of CTEs: found rows (file_id, line, ord, severity, description, tool), scores and tools by file."""
    category, fix = _sql_ladder("description", dims.CATEGORIES, quoted(dims.OTHER_CATEGORY)), _sql_ladder("description", dims.REMEDIATIONS, quoted(dims.OTHER_REMEDIATION))
    nl = "chr(10)"
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY file_id, severity ORDER BY line, tool <> 'regex', ord) AS k, count(*) OVER (PARTITION BY file_id, severity) AS n,
      list_position({sql_list(dims.SEVERITIES)}, severity) AS place FROM {found}),
    b AS (SELECT file_id, place, severity, any_value(n) AS n, {nl} || CASE WHEN place <= 2 THEN '⚠️ ' ELSE '🔸 ' END || severity || ' SEVERITY FINDINGS:' || {nl} ||
      string_agg('  ' || k || '. [Line ' || line || '] ' || description || {nl} || '     Category: ' || {category} || ' | Tool: ' || tool || {nl} || '     💡 Fix: ' || {fix}, {nl} ORDER BY k) ||
      CASE WHEN any_value(n) > 10 THEN {nl} || '     ... and ' || (any_value(n) - 10) || ' more' ELSE '' END AS t FROM r WHERE k <= 10 GROUP BY file_id, place, severity),
    p AS (SELECT file_id, string_agg(t, {nl} ORDER BY place) AS details, string_agg('    ' || severity || ': ' || n, {nl} ORDER BY place) AS counts, min(place) AS top FROM b GROUP BY file_id)
    SELECT s.file_id, concat_ws({nl}, '🔒 SECURITY SCAN REPORT', repeat('=', 70), '', '📊 OVERALL STATUS:', '  Security Score: ' || score || '/100', '  Risk Level: ' || risk_level,
      '  Status: ' || CASE WHEN risk_level IN ('LOW', 'INFO') THEN '✅ PASSED' ELSE '❌ SECURITY ISSUES DETECTED' END, '  Tools Used: ' || {tools}, '', '📈 SUMMARY:', '  Total Findings: ' || findings,
      CASE WHEN findings > 0 THEN '  Findings by Severity:' || {nl} || counts END, '', '💡 RECOMMENDATION: ' || CASE top {" ".join(f"WHEN {i + 1} THEN {quoted(t)}" for i, t in enumerate(dims.SUMMARY_ADVICE.values()))} WHEN 5 THEN {quoted(dims.SUMMARY_OTHER)} ELSE {quoted(dims.SUMMARY_NONE)} END,
      CASE WHEN findings > 0 THEN details ELSE {nl} || '🎉 No security findings detected!' END, '', repeat('=', 70), '🔍 Scan completed. Review findings above.') AS report
    FROM {scores} s LEFT JOIN p USING (file_id)"""


@query("security_report", f"WITH {SCORES_SQL}, {_report_sql('(SELECT *, ' + quoted('regex') + ' AS tool FROM dedup)', 'scores', quoted('Regex scanner only'))}")
def security_report(spark, d):
    lines = corpus.lines(spark, d)
    return scan.report(lines.select("file_id").distinct(), scan.deduplicated(scan.findings(lines, scan.rules(spark))))


# --- decisions and roll-ups


REVIEW_SQL = f"""{SCORES_SQL}, {LINT_SQL}, pred AS (SELECT doc_id % 150 AS file_id, quality = 1 AND toxic = 1 AS vulnerable, (doc_id % 100) / 100.0 AS confidence FROM labels),
p AS (SELECT file_id, count(*) FILTER (vulnerable) AS v, count(*) FILTER (vulnerable AND confidence >= 0.85) AS hc FROM pred GROUP BY file_id),
rev AS (SELECT s.file_id, l.score AS style_score, s.score AS security_score, risk_level, trunc(l.score * 0.4::DOUBLE + s.score * 0.6::DOUBLE)::INT AS overall_score, grave, coalesce(v, 0) AS v, coalesce(hc, 0) AS hc
  FROM scores s JOIN lint l USING (file_id) LEFT JOIN p USING (file_id)),
dec AS (SELECT *, CASE WHEN overall_score >= 90 THEN 'EXCELLENT' WHEN overall_score >= 75 THEN 'GOOD' WHEN overall_score >= 60 THEN 'FAIR' ELSE 'POOR' END AS overall_status,
  CASE WHEN hc > 0 OR security_score < 60 OR risk_level IN ('CRITICAL', 'HIGH') THEN 'REJECT' WHEN v > 0 THEN 'REVIEW_REQUIRED' WHEN security_score < 75 THEN 'REVIEW_RECOMMENDED' ELSE 'APPROVE' END AS final_decision FROM rev)"""


def _reviews(spark, d):
    labels = _table(spark, d, "labels")
    predictions = labels.select((F.col("doc_id") % 150).alias("file_id"), ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("vulnerable"), (F.col("doc_id") % 100 / 100.0).alias("confidence"))
    return review.reviewed(corpus.lines(spark, d), predictions)


@query("pipeline_decision", f"WITH {REVIEW_SQL} SELECT file_id, style_score, security_score, risk_level, overall_score, overall_status, final_decision FROM dec")
def pipeline_decision(spark, d):
    return _reviews(spark, d).drop("recommendations")


@query(
    "recommendations",
    f"""WITH {REVIEW_SQL} SELECT file_id, 0 AS ord, 'Address security issues (score: ' || security_score || '/100)' AS text FROM dec WHERE security_score < 80
    UNION ALL SELECT file_id, (CASE WHEN security_score < 80 THEN 1 ELSE 0 END), 'Fix ' || grave || ' critical/high security findings' FROM dec WHERE grave > 0
    UNION ALL SELECT file_id, (CASE WHEN security_score < 80 THEN 1 ELSE 0 END) + (CASE WHEN grave > 0 THEN 1 ELSE 0 END),
      CASE WHEN hc > 0 THEN 'CRITICAL: Model detected ' || hc || ' high-confidence vulnerable patterns' ELSE 'Model detected ' || v || ' vulnerable patterns (review recommended)' END FROM dec WHERE v > 0""",
)
def recommendations(spark, d):
    return _reviews(spark, d).select("file_id", F.posexplode("recommendations").alias("ord", "text"))


@query(
    "pr_summary",
    f"""WITH {REVIEW_SQL}, c AS (SELECT * FROM dec WHERE file_id IN (SELECT user_id FROM events WHERE event_id % 7 = 0))
    SELECT count(*) AS total_files, count(*) AS files_analyzed, CASE WHEN count(*) = 0 THEN 'NO_CHANGES' WHEN bool_or(final_decision = 'REJECT') THEN 'REJECT' WHEN bool_or(final_decision = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED'
      WHEN bool_or(final_decision = 'REVIEW_RECOMMENDED') THEN 'REVIEW_RECOMMENDED' ELSE 'APPROVE' END AS overall_decision, (coalesce(bool_or(final_decision = 'REJECT'), false))::INT AS exit_code FROM c""",
)
def pr_summary(spark, d):
    changed = _table(spark, d, "events").filter("event_id % 7 = 0").select(F.col("user_id").alias("file_id"))
    return review.change_set(_reviews(spark, d).join(changed, "file_id", "left_semi"))


@query(
    "summary_report",
    f"""WITH {LINES_SQL}, {LINT_SQL} SELECT count(*) AS total_files, count(*) FILTER (passed) AS passed_files, sum(errors)::BIGINT AS total_errors, sum(warnings)::BIGINT AS total_warnings, sum(infos)::BIGINT AS total_infos,
      round(avg(score), 2) AS average_score, count(*) - count(*) FILTER (passed) AS failed_files,
      CASE WHEN sum(errors) = 0 AND sum(warnings) = 0 THEN 'excellent' WHEN sum(errors) = 0 THEN 'good' ELSE 'acceptable' END AS overall_status, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 2) AS pass_rate FROM lint""",
)
def summary_report(spark, d):
    return review.style_summary(lint.lint_results(corpus.lines(spark, d)))


@query("language_distribution", f"WITH {LINES_SQL} SELECT language, count(DISTINCT file_id) AS files FROM lines GROUP BY language")
def language_distribution(spark, d):
    return corpus.lines(spark, d).groupBy("language").agg(F.countDistinct("file_id").alias("files"))


# --- graph


_STOPS_SQL = "stops AS (SELECT DISTINCT file_id, line FROM nodes WHERE node_type IN ('RETURN', 'BREAK', 'CONTINUE'))"
EDGES_SQL = f"""{NODES_SQL}, {_STOPS_SQL},
fn AS (WITH RECURSIVE up AS (SELECT file_id, id AS ancestor, id, 0 AS steps FROM nodes UNION ALL SELECT u.file_id, n.parent_id, u.id, steps + 1 FROM up u JOIN nodes n ON n.file_id = u.file_id AND n.id = u.ancestor WHERE n.parent_id IS NOT NULL)
  SELECT n.file_id, n.id, coalesce(f.fn, -1) AS fn FROM nodes n LEFT JOIN (SELECT u.file_id, u.id, arg_min(u.ancestor, steps) AS fn FROM up u JOIN nodes a ON a.file_id = u.file_id AND a.id = u.ancestor AND a.node_type = 'FUNCTION_DEF' GROUP BY u.file_id, u.id) f ON f.file_id = n.file_id AND f.id = n.id),
scoped_stops AS (SELECT DISTINCT n.file_id, fn, line FROM nodes n JOIN fn ON fn.file_id = n.file_id AND fn.id = n.id WHERE node_type IN ('RETURN', 'BREAK', 'CONTINUE')),
ctl AS (SELECT n.file_id, n.id AS src, line AS c_line, fn FROM nodes n JOIN fn ON fn.file_id = n.file_id AND fn.id = n.id WHERE node_type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT')),
body AS (SELECT c.file_id, src, c_line, fn, n.id AS dst, n.line AS b_line FROM ctl c JOIN nodes n ON n.file_id = c.file_id AND n.parent_id = c.src AND n.node_type <> 'BLOCK' AND NOT n.is_condition
  UNION ALL SELECT c.file_id, src, c_line, fn, m.id, m.line FROM ctl c JOIN nodes n ON n.file_id = c.file_id AND n.parent_id = c.src AND n.node_type = 'BLOCK' AND NOT n.is_condition
    JOIN nodes m ON m.file_id = n.file_id AND m.parent_id = n.id AND m.node_type NOT IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT')),
control AS (SELECT DISTINCT file_id, src, dst FROM body b WHERE NOT EXISTS (SELECT 1 FROM scoped_stops t WHERE t.file_id = b.file_id AND t.fn = b.fn AND t.line > b.c_line AND t.line < b.b_line)),
uses AS (SELECT file_id, id, var, bool_or(kind = 'def') AS d, bool_or(kind = 'use') AS u FROM refs GROUP BY ALL),
reach AS (SELECT u.*, n.node_type = 'FUNCTION_DEF' AS f, last_value(CASE WHEN d AND n.node_type <> 'FUNCTION_DEF' THEN u.id END IGNORE NULLS)
  OVER (PARTITION BY u.file_id, var ORDER BY line, col, u.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM uses u JOIN nodes n ON n.file_id = u.file_id AND n.id = u.id),
data AS (SELECT file_id, src, id AS dst, min(var) AS label FROM reach WHERE src IS NOT NULL AND ((d AND NOT f) OR (u AND (f OR NOT d))) GROUP BY ALL),
data_said AS (SELECT file_id, src, id AS dst, coalesce('def->def:' || min(var) FILTER (d AND NOT f), 'def->use:' || min(var)) AS label FROM reach WHERE src IS NOT NULL AND ((d AND NOT f) OR (u AND (f OR NOT d))) GROUP BY ALL),
calls AS (SELECT n.file_id, n.id AS src, g.dst FROM nodes n JOIN (SELECT file_id, name, max(id) AS dst FROM nodes WHERE node_type = 'FUNCTION_DEF' GROUP BY ALL) g
  ON g.file_id = n.file_id AND g.name = n.name WHERE n.node_type = 'CALL' AND n.id <> g.dst),
seq AS (SELECT file_id, id AS src, parent_id, line AS c_line, lead(id) OVER w AS dst, lead(parent_id) OVER w AS np, lead(line) OVER w AS b_line FROM nodes WINDOW w AS (PARTITION BY file_id ORDER BY line, col, id)),
ordered AS (SELECT file_id, src, dst FROM seq s WHERE dst IS NOT NULL AND parent_id IS NOT DISTINCT FROM np
  AND NOT EXISTS (SELECT 1 FROM stops t WHERE t.file_id = s.file_id AND t.line > s.c_line AND t.line < s.b_line)),
structural AS (SELECT file_id, parent_id AS src, id AS dst FROM nodes WHERE parent_id IS NOT NULL),
edges AS (SELECT DISTINCT * FROM (SELECT *, 'control' AS edge_type FROM control UNION ALL SELECT file_id, src, dst, 'data' FROM data UNION ALL SELECT *, 'call' FROM calls
  UNION ALL SELECT *, 'order' FROM ordered UNION ALL SELECT *, 'structural' FROM structural) WHERE src <> dst)"""


def _graph(name, build, sql):
    QUERIES[name] = lambda spark, d: build(corpus.nodes(spark, d), corpus.var_refs(spark, d))
    ORACLE_SQL[name] = f"WITH {EDGES_SQL} {sql}"


_graph("graph_structural", lambda n, r: graph.structural_edges(n), "SELECT * FROM structural")
_graph("graph_control", lambda n, r: graph.control_edges(n), "SELECT * FROM control")
_graph("graph_data", graph.data_edges, "SELECT * FROM data")
_graph("graph_call", lambda n, r: graph.call_edges(n), "SELECT * FROM calls")
_graph("graph_order", lambda n, r: graph.order_edges(n), "SELECT * FROM ordered")
_graph("graph_edge_counts", lambda n, r: graph.edges(n, r).groupBy("edge_type").agg(F.count("*").alias("n")), "SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def _any_of(words: dict[str, list[str]], test: str) -> str:
    """SQL: whether the code of a node passes test for one of its language's words."""
    return "(" + " OR ".join(f"(language = {quoted(x)} AND (" + " OR ".join(test % quoted(w) for w in ws) + "))" for x, ws in words.items()) + ")"


_SINK_KINDS = list(dict.fromkeys(k for k, _ in dims.SINK_PATTERNS))
_SINK_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"regexp_matches(code, {quoted('(?i)' + p)})" for x, p in dims.SINK_PATTERNS if x == k) + f" THEN {quoted(k)}" for k in reversed(_SINK_KINDS)
) + " END"
_SEEDS_SQL = f"""marked AS (SELECT *, {_any_of(dims.TAINT_SOURCES, "regexp_matches(code, '(?i)' || %s)")} AS source, {_any_of(dims.SANITIZERS, "contains(code, %s)")} AS clean, {_SINK_SQL} AS sink FROM nodes),
seeds AS (SELECT DISTINCT r.file_id, r.id FROM refs r JOIN marked n ON n.file_id = r.file_id AND n.id = r.id WHERE r.kind = 'def' AND n.node_type = 'CALL' AND source)"""
_graph("taint_seed", graph.taint_seeds, f", {_SEEDS_SQL} SELECT * FROM seeds")
_TAINT_SQL = f"""{EDGES_SQL}, {_SEEDS_SQL}, step AS (SELECT d.file_id, d.src, d.dst FROM data d JOIN marked n ON n.file_id = d.file_id AND n.id = d.dst WHERE NOT clean AND EXISTS (SELECT 1 FROM refs r WHERE r.file_id = d.file_id AND r.id = d.dst AND r.kind = 'def')),
    t AS (SELECT file_id, id FROM seeds UNION SELECT s.file_id, s.dst FROM t JOIN step s ON s.file_id = t.file_id AND s.src = t.id)"""
_ISSUES_SQL = f"""{_TAINT_SQL}, names AS (SELECT DISTINCT r.file_id, r.var FROM refs r JOIN t ON t.file_id = r.file_id AND t.id = r.id WHERE r.kind = 'def'),
    issues AS (SELECT n.file_id, n.id, n.line, substr(n.code, 1, 60) AS code, sink AS type FROM marked n WHERE n.node_type IN ('CALL', 'ASSIGNMENT', 'EXPRESSION') AND sink IS NOT NULL AND NOT clean AND length(trim(n.code)) >= 5
      AND EXISTS (SELECT 1 FROM refs r JOIN names v ON v.file_id = r.file_id AND v.var = r.var WHERE r.file_id = n.file_id AND r.id = n.id AND r.kind = 'use')
      AND NOT EXISTS (SELECT 1 FROM data d JOIN marked c ON c.file_id = d.file_id AND c.id = d.src WHERE d.file_id = n.file_id AND d.dst = n.id AND c.clean))"""


_INTENT_SQL = f"""{NODES_SQL}, up AS (SELECT file_id, id AS ancestor, id FROM nodes UNION ALL SELECT u.file_id, n.parent_id, u.id FROM up u JOIN nodes n ON n.file_id = u.file_id AND n.id = u.ancestor WHERE n.parent_id IS NOT NULL),
  read AS (SELECT file_id, id, node_type FROM nodes WHERE {_any_of(dims.TAINT_SOURCES, "contains(code, %s)")}),
  near AS (SELECT r.file_id, max(u.ancestor) AS id FROM read r JOIN up u ON u.file_id = r.file_id AND u.id = r.id JOIN nodes a ON a.file_id = u.file_id AND a.id = u.ancestor AND a.node_type IN ('ASSIGNMENT', 'VARIABLE') GROUP BY r.file_id, r.id
    UNION ALL SELECT file_id, id FROM read WHERE node_type = 'CALL')"""


@query("taint_seed_intent", f"WITH RECURSIVE {_INTENT_SQL} SELECT DISTINCT n.file_id, n.id FROM near n JOIN refs r ON r.file_id = n.file_id AND r.id = n.id AND r.kind = 'def'")
def taint_seed_intent(spark, d):
    return graph.taint_seeds(corpus.nodes(spark, d), corpus.var_refs(spark, d), intent=True)


@query("taint_closure", f"WITH RECURSIVE {_TAINT_SQL} SELECT file_id, id FROM t")
def taint_closure(spark, d):
    n, r = corpus.nodes(spark, d), corpus.var_refs(spark, d)
    return graph.taint_closure(graph.taint_seeds(n, r), graph.data_edges(n, r), n, r)


@query("taint_issues", f"WITH RECURSIVE {_ISSUES_SQL} SELECT file_id, id, line, code, type, true AS tainted, coalesce((SELECT string_agg(DISTINCT var, ',' ORDER BY var) FROM refs r WHERE r.file_id = i.file_id AND r.id = i.id AND kind = 'use'), '') AS used FROM issues i")
def taint_issues(spark, d):
    found = graph.taint_issues(corpus.nodes(spark, d), corpus.var_refs(spark, d))
    return found.select("file_id", "id", "line", "code", "type", "tainted", F.array_join("used", ",").alias("used"))


@query("graph_stats", f"WITH RECURSIVE {_ISSUES_SQL} SELECT n.file_id, n.c AS nodes, coalesce(e.c, 0) AS edges, coalesce(i.c, 0) AS issues FROM (SELECT file_id, count(*) AS c FROM nodes GROUP BY ALL) n LEFT JOIN (SELECT file_id, count(*) AS c FROM edges GROUP BY ALL) e USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS c FROM issues GROUP BY ALL) i USING (file_id)")
def graph_stats(spark, d):
    n, r = corpus.nodes(spark, d), corpus.var_refs(spark, d)
    return graph.graph_stats(n, graph.edges(n, r), graph.taint_issues(n, r))


#: Each edge with what is written on it.
_SAID_SQL = """, said AS (SELECT e.*, CASE e.edge_type WHEN 'structural' THEN 'parent-child' WHEN 'order' THEN 'order' WHEN 'call' THEN 'calls:' || t.name WHEN 'control' THEN 'control->body:' || lower(s.node_type) ELSE d.label END AS label
    FROM edges e JOIN nodes s ON s.file_id = e.file_id AND s.id = e.src JOIN nodes t ON t.file_id = e.file_id AND t.id = e.dst LEFT JOIN data_said d ON d.file_id = e.file_id AND d.src = e.src AND d.dst = e.dst)"""
_graph("graph_simple", graph.simple_graph, _SAID_SQL + " SELECT file_id, src, dst, unnest(arg_max({'edge_type': edge_type, 'label': label, 'weight': 1.0::DOUBLE}, list_position(['structural', 'control', 'data', 'call', 'order'], edge_type))) FROM said GROUP BY file_id, src, dst")
_graph("edge_records", lambda n, r: graph.edge_records(graph.labelled_edges(n, r)), _SAID_SQL + " SELECT file_id, src AS source, dst AS target, edge_type || '_dependency' AS type, label, 1.0::DOUBLE AS weight FROM said")
_graph("node_function", lambda n, r: graph.with_function(n).select("file_id", "id", "function"), "SELECT file_id, id, nullif(fn, -1) AS function FROM fn")
_graph(
    "node_records",
    lambda n, r: graph.node_records(n, r).select("file_id", "id", F.to_json(F.struct("id", "code", "line", "type", "function_name", "class_name", "variables_defined", "variables_used", "is_control_node", "is_control_terminator", "is_phi_node"), {"ignoreNullFields": "false"}).alias("json")),
    """SELECT n.file_id, n.id, to_json({'id': n.id, 'code': code, 'line': line, 'type': lower(node_type), 'function_name': CASE WHEN node_type = 'FUNCTION_DEF' THEN name END, 'class_name': CASE WHEN node_type = 'CLASS_DEF' THEN name END,
      'variables_defined': CASE WHEN kind = 'def' THEN [var] ELSE [] END, 'variables_used': CASE WHEN kind = 'use' THEN [var] ELSE [] END, 'is_control_node': node_type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT'), 'is_control_terminator': node_type IN ('RETURN', 'BREAK', 'CONTINUE'), 'is_phi_node': false})::VARCHAR AS json
    FROM nodes n JOIN refs r ON r.file_id = n.file_id AND r.id = n.id""",
)


@query(
    "ml_features",
    f"""WITH {NODES_SQL} SELECT n.file_id, (row_number() OVER (PARTITION BY n.file_id ORDER BY n.id) - 1)::INT AS idx, concat_ws(',', length(code), line, col, (n.id > 0)::INT + (n.id > 25 AND n.id % 25 <> 0)::INT + (n.id % 5 <> 0 AND n.id % 25 > 4)::INT,
      (node_type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT'))::INT, (node_type = 'FUNCTION_DEF')::INT, (node_type IN ('RETURN', 'BREAK', 'CONTINUE'))::INT, 0, (kind = 'def')::INT, (kind = 'use')::INT,
      array_to_string([(node_type = x)::INT for x in {sql_list(dims.ALL_NODE_TYPES)}], ',')) AS features FROM nodes n JOIN refs r ON r.file_id = n.file_id AND r.id = n.id""",
)
def ml_features(spark, d):
    df = graph.features(corpus.nodes(spark, d), corpus.var_refs(spark, d))
    return df.select("file_id", "idx", F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",").alias("features"))


@query("call_name", "SELECT event_id, CASE WHEN contains(c, '(') THEN trim(string_split(string_split(c, '(')[1], '.')[-1]) END AS name FROM (SELECT event_id, ['a.b.run (x)', 'f(g.h(1))', 'no call', '  go( )'][1 + event_id % 4] AS c FROM events)")
def call_name(spark, d):
    code = corpus.pick(["a.b.run (x)", "f(g.h(1))", "no call", "  go( )"], F.col("event_id") % 4)
    return _table(spark, d, "events").select("event_id", graph.call_name(code).alias("name"))


@query("node_type_map", f"SELECT event_id, {_sql_ladder('t', dims.NODE_TYPES, quoted(dims.OTHER_NODE_TYPE))} AS node_type FROM (SELECT event_id, {sql_list(['if_statement', 'method_invocation', 'class_body', 'call_expression', 'identifier', 'import_declaration', 'return_statement'])}[1 + event_id % 7] AS t FROM events)")
def node_type_map(spark, d):
    t = corpus.pick(["if_statement", "method_invocation", "class_body", "call_expression", "identifier", "import_declaration", "return_statement"], F.col("event_id") % 7)
    return _table(spark, d, "events").select("event_id", ladders.node_type(t).alias("node_type"))


# --- flows


_FLOW_PARTS = [
    ["request.getParameter", "raw_input()", "window.location.search", "$_POST", "socket.read", "URLSearchParams"],
    ["PreparedStatement.execute", "os.system", "element.innerHTML", "mysqli_query", "logger.info"],
    ["none", "bind_param", "unsanitized", "custom"],
]


@query(
    "flow_normalize",
    f"""WITH f AS (SELECT event_id, {sql_list(_FLOW_PARTS[0])}[1 + event_id % 6] AS a, {sql_list(_FLOW_PARTS[1])}[1 + event_id % 5] AS b, {sql_list(_FLOW_PARTS[2])}[1 + event_id % 4] AS c FROM events)
    SELECT event_id, {_sql_ladder('a', dims.FLOW_SOURCES, 'a')} AS source, {_sql_ladder('b', dims.FLOW_SINKS, 'b')} AS sink, {_sql_ladder('c', dims.FLOW_SANITIZERS, 'c')} AS sanitization FROM f""",
)
def flow_normalize(spark, d):
    parts = [corpus.pick(p, F.col("event_id") % len(p)) for p in _FLOW_PARTS]
    return _table(spark, d, "events").select("event_id", *ladders.normalized_flow(*parts))


@query("label_counts", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality")
def label_counts(spark, d):
    return _table(spark, d, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))


@query(
    "label_rotation",
    "WITH i AS (SELECT row_number() OVER (ORDER BY doc_id, quality) - 1 AS idx, quality AS label FROM labels) SELECT idx, label, '[VULNERABILITY_FLOW]' || chr(10) || CASE WHEN label = 1 THEN "
    + " ELSE ".join(
        sql_list([f"SOURCE: {a}\nSINK: {b}\nSANITIZATION: {c}" for a, b, c in dims.FLOW_TEXTS[k]]) + "[1 + idx % 6]" for k in (1, 0)
    )
    + " END AS text FROM i",
)
def label_rotation(spark, d):
    return flows.training_texts(_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")))


@query(
    "classification_metrics",
    """WITH c AS (SELECT count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn, count(*) FILTER (toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fn, count(*) FILTER (toxic = 1 AND quality = 1) AS tp FROM labels)
    SELECT tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
      round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def classification_metrics(spark, d):
    return flows.metrics(_table(spark, d, "labels"), "toxic", "quality")


@query(
    "get_decision",
    """SELECT doc_id, CASE WHEN toxic = 1 AND c > 0.7 THEN 'BLOCK' WHEN toxic = 1 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, CASE WHEN toxic = 1 AND c > 0.7 THEN 'HIGH' WHEN toxic = 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority
    FROM (SELECT *, (doc_id % 100) / 100.0 AS c FROM labels)""",
)
def get_decision(spark, d):
    chosen = ladders.get_decision(F.col("toxic") == 1, F.col("doc_id") % 100 / 100.0)
    return _table(spark, d, "labels").select("doc_id", chosen.alias("x")).select("doc_id", "x.decision", "x.priority")


@query(
    "pr_block_decision",
    "SELECT CASE WHEN bool_or(toxic = 1 AND (doc_id % 100) / 100.0 > 0.8) THEN 'BLOCK' WHEN bool_or(toxic = 1) THEN 'REVIEW_REQUIRED' ELSE 'APPROVE' END AS decision FROM labels",
)
def pr_block_decision(spark, d):
    return flows.change_set_decision(_table(spark, d, "labels").select((F.col("toxic") == 1).alias("vulnerable"), (F.col("doc_id") % 100 / 100.0).alias("confidence")))


@query("classifier_fit")
def classifier_fit(spark, d):
    train = label_rotation(spark, d)
    return flows.fitted_classifier(train.select("text", "label")).transform(train).groupBy("label", "prediction").agg(F.count("*").alias("n"))


# --- trees, sinks and dense indexes


_UP_SQL = "up AS (SELECT file_id, id AS ancestor, id FROM nodes UNION ALL SELECT u.file_id, n.parent_id, u.id FROM up u JOIN nodes n ON n.file_id = u.file_id AND n.id = u.ancestor WHERE n.parent_id IS NOT NULL)"


def _tree(name, build, sql):
    QUERIES[name] = lambda spark, d: build(corpus.nodes(spark, d), corpus.var_refs(spark, d))
    ORACLE_SQL[name] = f"WITH RECURSIVE {NODES_SQL}, {_UP_SQL} {sql}"


_tree(
    "function_summary", graph.function_summaries,
    "SELECT u.file_id, u.ancestor AS id, count(DISTINCT r.var) FILTER (r.kind = 'use') AS uses, bool_or(n.node_type = 'RETURN') AS returns FROM up u JOIN nodes f ON f.file_id = u.file_id AND f.id = u.ancestor AND f.node_type = 'FUNCTION_DEF' "
    "JOIN nodes n ON n.file_id = u.file_id AND n.id = u.id LEFT JOIN refs r ON r.file_id = u.file_id AND r.id = u.id GROUP BY ALL",
)
_DEFINED_SQL = "SELECT DISTINCT u.file_id, u.ancestor AS id, r.var FROM up u JOIN refs r ON r.file_id = u.file_id AND r.id = u.id WHERE r.kind = 'def'"
_tree("subtree_vars", graph.subtree_definitions, _DEFINED_SQL)
_tree(
    "branch_merge_vars", graph.branch_merges,
    f", defined AS ({_DEFINED_SQL}), kids AS (SELECT n.file_id, n.parent_id, n.id, row_number() OVER (PARTITION BY n.file_id, n.parent_id ORDER BY n.id) AS b FROM nodes n JOIN nodes p ON p.file_id = n.file_id AND p.id = n.parent_id WHERE p.node_type = 'IF_STATEMENT') "
    "SELECT k.file_id, k.parent_id AS id, d.var FROM kids k JOIN defined d ON d.file_id = k.file_id AND d.id = k.id WHERE b <= 2 GROUP BY ALL HAVING count(DISTINCT b) = 2",
)
_MERGES_SQL = f"""{NODES_SQL.replace('event_id % 11', 'event_id % 4').replace('event_id % 3 = 0 THEN', 'event_id % 3 <> 0 THEN')}, {_UP_SQL}, last AS (SELECT file_id, ancestor AS id, max(id) AS last FROM up GROUP BY ALL),
  kids AS (SELECT n.file_id, n.parent_id, n.id, row_number() OVER (PARTITION BY n.file_id, n.parent_id ORDER BY n.id) AS b FROM nodes n JOIN nodes p ON p.file_id = n.file_id AND p.id = n.parent_id WHERE p.node_type = 'IF_STATEMENT'),
  ends AS (SELECT k.file_id, k.parent_id AS id, b, var, max(r.id) AS z FROM kids k JOIN up u ON u.file_id = k.file_id AND u.ancestor = k.id JOIN refs r ON r.file_id = u.file_id AND r.id = u.id AND r.kind = 'def' WHERE b <= 2 GROUP BY ALL),
  points AS (SELECT e.file_id, e.id, var, l.last, min(z) AS a, max(z) AS b, row_number() OVER (PARTITION BY e.file_id, l.last ORDER BY e.id DESC, var) AS k FROM ends e JOIN last l ON l.file_id = e.file_id AND l.id = e.id GROUP BY e.file_id, e.id, var, l.last HAVING count(*) = 2),
  ids AS (SELECT file_id, id, id + (SELECT count(*) FROM points p WHERE p.file_id = n.file_id AND p.last < n.id) AS new FROM nodes n)"""


def _with_merges(spark, d):
    return merges.with_merges(corpus.nodes(spark, d), corpus.var_refs(spark, d, 4, (1, 2)))


@query(
    "graph_merges",
    f"""WITH RECURSIVE {_MERGES_SQL} SELECT p.file_id, x.new + k AS id, y.new AS parent_id, var, a.new AS src_1, b.new AS src_2, p.var || ' = phi(' || p.var || ', ' || p.var || ')' AS code
    FROM points p JOIN nodes n ON n.file_id = p.file_id AND n.id = p.id JOIN ids x ON x.file_id = p.file_id AND x.id = p.last LEFT JOIN ids y ON y.file_id = p.file_id AND y.id = n.parent_id
      JOIN ids a ON a.file_id = p.file_id AND a.id = p.a JOIN ids b ON b.file_id = p.file_id AND b.id = p.b""",
)
def graph_merges(spark, d):
    nodes, _, joined = _with_merges(spark, d)
    ends = joined.groupBy("file_id", F.col("dst").alias("id")).agg(F.min("src").alias("src_1"), F.max("src").alias("src_2"))
    return nodes.filter("node_type = 'PHI_NODE'").join(ends, ["file_id", "id"]).select("file_id", "id", "parent_id", F.col("name").alias("var"), "src_1", "src_2", "code")


@query(
    "merged_features",
    f"""WITH RECURSIVE {_MERGES_SQL}, c AS (SELECT file_id, count(*) AS n FROM points GROUP BY file_id) SELECT n.file_id, count(*) + coalesce(any_value(c.n), 0) AS nodes, coalesce(any_value(c.n), 0) AS phi_nodes,
      count(*) FILTER (kind = 'def') + coalesce(any_value(c.n), 0) AS definitions, max(id) + coalesce(any_value(c.n), 0) AS last FROM nodes n JOIN refs r USING (file_id, id) LEFT JOIN c USING (file_id) GROUP BY n.file_id""",
)
def merged_features(spark, d):
    """Feature vectors of the graph with merge nodes, summed by file: the phi flag and the definitions."""
    nodes, refs, _ = _with_merges(spark, d)
    f = graph.features(nodes, refs)
    of = lambda i: F.sum(F.get("features", F.lit(i))).cast("bigint")
    return f.groupBy("file_id").agg(F.count("*").alias("nodes"), of(7).alias("phi_nodes"), of(8).alias("definitions"), F.max("idx").cast("bigint").alias("last"))


_graph(
    "ml_edge_index", lambda n, r: graph.edge_index(n, graph.edges(n, r)),
    f", dense AS (SELECT file_id, id, (row_number() OVER (PARTITION BY file_id ORDER BY id) - 1)::INT AS idx FROM nodes) SELECT e.file_id, a.idx AS src_idx, b.idx AS dst_idx, (list_position({sql_list(graph.EDGE_TYPES)}, edge_type) - 1)::INT AS type_ord "
    "FROM edges e JOIN dense a ON a.file_id = e.file_id AND a.id = e.src JOIN dense b ON b.file_id = e.file_id AND b.id = e.dst",
)
_graph(
    "semantic_tags", graph.semantic_tags,
    """SELECT n.file_id, n.id, array_to_string(list_sort(list_filter([CASE WHEN node_type IN ('IF_STATEMENT', 'FOR_STATEMENT', 'WHILE_STATEMENT') THEN 'control_structure' END, CASE WHEN node_type IN ('RETURN', 'BREAK', 'CONTINUE') THEN 'control_terminator' END,
      CASE WHEN node_type = 'FUNCTION_DEF' THEN 'function:' || name END, CASE WHEN node_type = 'CLASS_DEF' THEN 'class:' || name END, CASE WHEN kind = 'def' THEN 'defines' END, CASE WHEN kind = 'use' THEN 'uses' END], lambda x: x IS NOT NULL)), ',') AS tags
    FROM nodes n JOIN refs r ON r.file_id = n.file_id AND r.id = n.id""",
)


_NAMES = ["total", "print", "String", "_x", "$value", "9lives", "if", "None", "puts", "echo", "func", "len", "x1"]


@query(
    "valid_variables",
    f"""WITH v AS (SELECT event_id, {sql_list(dims.LANGUAGES)}[1 + event_id % 6] AS language, {sql_list(_NAMES)}[1 + (event_id // 6) % {len(_NAMES)}] AS name FROM events), b AS (SELECT *, regexp_replace(name, '^\\$', '') AS bare FROM v)
    SELECT event_id, language, name FROM b WHERE regexp_matches(bare, '^[a-zA-Z_]') AND NOT ("""
    + " OR ".join(f"language = {quoted(x)} AND (list_contains({sql_list(dims.KEYWORDS[x])}, lower(bare)) OR list_contains({sql_list(dims.BUILTINS[x])}, bare))" for x in dims.LANGUAGES)
    + ")",
)
def valid_variables(spark, d):
    names = _table(spark, d, "events").select("event_id", corpus.language_of(F.col("event_id")).alias("language"), corpus.pick(_NAMES, F.floor(F.col("event_id") / 6) % len(_NAMES)).alias("name"))
    return graph.valid_variables(names)


# --- more of flows, style and change sets


@query(
    "flow_extract",
    f"""WITH {FILES_SQL}, x AS (SELECT file_id, {sql_list(dims.LANGUAGES)}[1 + file_id % 6] AS language, lower(code || CASE WHEN file_id % 2 = 0 THEN ' input( shlex.quote' ELSE ' input(' END) AS c FROM files)
    SELECT file_id, CASE WHEN language = 'python' AND contains(c, 'input(') AND contains(c, 'os.system') THEN 'input()' ELSE 'internal' END AS source,
      CASE WHEN language = 'python' AND contains(c, 'input(') AND contains(c, 'os.system') THEN 'os.system' ELSE 'safe_operation' END AS sink,
      CASE WHEN language = 'python' AND contains(c, 'input(') AND contains(c, 'os.system') THEN CASE WHEN contains(c, 'shlex.quote') THEN 'shlex.quote' ELSE 'none' END ELSE 'sanitized' END AS sanitization FROM x""",
)
def flow_extract(spark, d):
    tail = F.when(F.col("file_id") % 2 == 0, " input( shlex.quote").otherwise(" input(")
    found = flows.extracted(F.concat("code", tail), corpus.language_of(F.col("file_id")))
    return corpus.files(spark, d).select("file_id", found.alias("f")).select("file_id", "f.*")


@query(
    "prediction_counts",
    """SELECT doc_id % 50 AS file_id, count(*) AS total, count(*) FILTER (toxic = 1) AS vulnerable, count(*) FILTER (toxic = 1 AND (doc_id % 100) / 100.0 >= 0.85) AS confident FROM labels GROUP BY doc_id % 50""",
)
def prediction_counts(spark, d):
    sure = (F.col("toxic") == 1) & (F.col("doc_id") % 100 / 100.0 >= 0.85)
    return _table(spark, d, "labels").groupBy((F.col("doc_id") % 50).alias("file_id")).agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("vulnerable"), F.count_if(sure).alias("confident"))


@query("running_stats", f"WITH {LINES_SQL}, {LINT_SQL} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, sum(warnings)::BIGINT AS warnings, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 6) AS pass_rate FROM lint")
def running_stats(spark, d):
    rate = F.round(F.count_if("passed") * F.lit(100.0).cast("double") / F.count("*"), 6)
    return lint.lint_results(corpus.lines(spark, d)).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.sum("warnings").alias("warnings"), rate.alias("pass_rate"))


@query(
    "style_status",
    """SELECT doc_id, CASE WHEN length(t) < 5 THEN 'ERROR' ELSE 'SUCCESS' END AS status, length(t) AS size FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""",
)
def style_status(spark, d):
    size = F.length(ladders.stripped(F.col("text")))
    return _table(spark, d, "documents").select("doc_id", F.when(size < 5, "ERROR").otherwise("SUCCESS").alias("status"), size.cast("bigint").alias("size"))


@query("detect_shebang", """SELECT event_id, ['python', 'javascript', 'ruby', 'php', 'shell', 'shell', NULL][1 + event_id % 7] AS language FROM events""")
def detect_shebang(spark, d):
    words = ["#!/usr/bin/env python3", "#!/usr/bin/node", "#!/usr/bin/ruby -w", "#! /usr/bin/php", "#!/bin/bash", "#!/bin/sh", "# no interpreter"]
    code = F.concat(F.lit("\n  "), corpus.pick(words, F.col("event_id") % 7), F.lit("\nx = 1"))
    return _table(spark, d, "events").select("event_id", detect.by_shebang(code).alias("language"))


@query("review_json")
def review_json(spark, d):
    df = _reviews(spark, d)
    return df.select("file_id", F.to_json(F.struct(*df.columns)).alias("json"))
