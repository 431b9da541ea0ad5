"""Queries of whole reviews, their reports and the short way from code to decision, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import DETECT_SQL, LINT_SQL, REVIEW_SQL, SCORES_SQL, _found, _sql_ladder, _table, ORACLE_SQL, query
from .catalog_tools import ALL_ITEMS_SQL
from .functions import dims, ladders
from .operators import detect, flows, snapshots, training
from .plans import review, style
from .sources import corpus, parser, tool_runs
from .sources.corpus import FILES_SQL, LINES_SQL, quoted, sql_list
from .streaming import session_statistics

_GATED_SQL = f"{DETECT_SQL}, gate AS (SELECT d.*, f.filename, f.code AS whole, coalesce(confidence >= 0.7 AND language IN ({', '.join(map(quoted, dims.LANGUAGES))}), false) AS ok FROM det d JOIN files f USING (file_id))"
_SRC_SQL = "src AS (SELECT file_id, generate_subscripts(string_split(whole, chr(10)), 1) AS line, language, unnest(string_split(whole, chr(10))) AS text FROM gate WHERE ok)"


def _over_source(sql: str) -> str:
    """CTEs that were written over the corpus's lines, over the lines of files whose language was detected."""
    return sql.replace(LINES_SQL + ", ", "").replace("FROM lines", "FROM src")


_CATEGORY = _sql_ladder("description", dims.CATEGORIES, quoted(dims.OTHER_CATEGORY))
_NORMAL_SINK = _sql_ladder("sink", dims.FLOW_SINKS, "sink")
_NORMAL_SOURCE = _sql_ladder("source", dims.FLOW_SOURCES, "source")
_NORMAL_CLEAN = _sql_ladder("sanitization", dims.FLOW_SANITIZERS, "sanitization")
_PREDICTED = f"""SELECT *, clean = 'none' AS vulnerable, CASE WHEN clean = 'none' AND (ns IN ({', '.join(quoted(v) for _, v in dims.FLOW_SOURCES)}) OR nk IN ({', '.join(quoted(v) for _, v in dims.FLOW_SINKS)})) THEN 0.95 WHEN clean = 'none' THEN 0.75 WHEN clean = 'unknown' THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence
  FROM (SELECT *, {_NORMAL_SOURCE} AS ns, {_NORMAL_SINK} AS nk, {_NORMAL_CLEAN} AS clean FROM %s)"""
ROWS_SQL = f"""{_GATED_SQL}, {_SRC_SQL}, {_over_source(SCORES_SQL)}, {_over_source(LINT_SQL)},
asked AS (SELECT g.file_id, coalesce(d.sink, 'system_call') AS sink, 'user_input' AS source, coalesce(CASE WHEN contains(lower(d.sink), 'injection') THEN 'none' END, 'unknown') AS sanitization
  FROM (SELECT file_id FROM gate WHERE ok) g LEFT JOIN (SELECT file_id, {_CATEGORY} AS sink FROM dedup QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line, ord) <= 2) d USING (file_id)),
p AS (SELECT file_id, count(*) FILTER (vulnerable) AS v, count(*) FILTER (vulnerable AND confidence >= 0.85) AS hc FROM ({_PREDICTED % 'asked'}) GROUP BY file_id),
rev AS (SELECT s.file_id, l.score AS style_score, s.score AS security_score, risk_level, findings, grave, v, hc, trunc(l.score * 0.4::DOUBLE + s.score * 0.6::DOUBLE)::INT AS overall_score FROM scores s JOIN lint l USING (file_id) JOIN p USING (file_id)),
said AS (SELECT *, CASE WHEN overall_score >= 90 THEN 'EXCELLENT' WHEN overall_score >= 75 THEN 'GOOD' WHEN overall_score >= 60 THEN 'FAIR' ELSE 'POOR' END AS overall_status,
  CASE WHEN hc > 0 OR security_score < 60 OR risk_level IN ('CRITICAL', 'HIGH') THEN 'REJECT' WHEN v > 0 THEN 'REVIEW_REQUIRED' WHEN security_score < 75 THEN 'REVIEW_RECOMMENDED' ELSE 'APPROVE' END AS final_decision,
  list_filter([CASE WHEN style_score < 70 THEN 'Improve code style (score: ' || style_score || '/100)' END, CASE WHEN security_score < 80 THEN 'Address security issues (score: ' || security_score || '/100)' END,
    CASE WHEN grave > 0 THEN 'Fix ' || grave || ' critical/high security findings' END, CASE WHEN hc > 0 THEN 'CRITICAL: Model detected ' || hc || ' high-confidence vulnerable patterns' WHEN v > 0 THEN 'Model detected ' || v || ' vulnerable patterns (review recommended)' END], lambda x: x IS NOT NULL) AS recs FROM rev),
whole AS (SELECT g.file_id, g.filename, coalesce(g.language, 'unknown') AS language, round(g.confidence, 6) AS confidence, CASE WHEN ok THEN 'SUCCESS' ELSE 'SKIPPED' END AS style_status, CASE WHEN ok THEN 'SUCCESS' ELSE 'SKIPPED' END AS security_status,
  coalesce(style_score, 0) AS style_score, coalesce(security_score, 0) AS security_score, coalesce(overall_score, 0) AS overall_score, coalesce(risk_level, 'UNKNOWN') AS risk_level, coalesce(findings, 0) AS findings,
  CASE WHEN ok THEN overall_status ELSE 'UNSUPPORTED_LANGUAGE' END AS overall_status, CASE WHEN ok THEN final_decision ELSE 'REJECT' END AS final_decision,
  CASE WHEN ok THEN recs ELSE ['Language detection failed: ' || CASE WHEN confidence < 0.7 THEN 'Low confidence detection (' || printf('%.1f', confidence * 100) || '% < 70%)' ELSE 'Unsupported language: ' || coalesce(g.language, 'unknown') END] END AS recs
  FROM gate g LEFT JOIN said USING (file_id))"""


@query("review_rows", f"WITH {ROWS_SQL} SELECT * EXCLUDE (recs), array_to_string(recs, chr(10)) AS recommendations FROM whole")
def review_rows(spark, d):
    df = review.whole_reviews(corpus.files(spark, d))
    return df.withColumns({"recommendations": F.array_join("recommendations", "\n"), "confidence": F.round("confidence", 6)})


_TEXT_SQL = f"""{ROWS_SQL}, told AS (SELECT file_id, count(*) AS n, count(*) FILTER (vulnerable) AS v, count(*) FILTER (vulnerable AND confidence >= 0.85) AS hc,
  string_agg('    ' || k || '. Source: ' || source || chr(10) || '       Sink: ' || sink || chr(10) || '       Prediction: ' || CASE WHEN vulnerable THEN 'VULNERABLE' ELSE 'SAFE' END || chr(10) ||
    '       Confidence: ' || printf('%.1f', confidence * 100) || '%' || chr(10) || '       High-confidence: ' || CASE WHEN confidence >= 0.85 THEN '✅' ELSE '❌' END, chr(10) ORDER BY k) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY place) AS k FROM ({_PREDICTED % 'placed'})) GROUP BY file_id)"""
_TEXT_SQL = _TEXT_SQL.replace("p AS (SELECT file_id, count(*) FILTER (vulnerable)", """placed AS (SELECT g.file_id, coalesce(d.sink, 'system_call') AS sink, 'user_input' AS source, coalesce(CASE WHEN contains(lower(d.sink), 'injection') THEN 'none' END, 'unknown') AS sanitization, coalesce(line * 1000 + ord, 0) AS place
  FROM (SELECT file_id FROM gate WHERE ok) g LEFT JOIN (SELECT file_id, line, ord, """ + _CATEGORY + """ AS sink FROM dedup QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line, ord) <= 2) d USING (file_id)),
p AS (SELECT file_id, count(*) FILTER (vulnerable)""", 1)


@query(
    "review_text",
    f"""WITH {_TEXT_SQL} SELECT w.file_id, concat_ws(chr(10), repeat('=', 80), '📋 FINAL ANALYSIS REPORT', repeat('=', 80), '', '🔤 Language: ' || language, '📁 File: ' || filename, '', '📋 STYLE ANALYSIS:', '  Score: ' || style_score || '/100',
      '  Status: ' || CASE WHEN style_status = 'SUCCESS' THEN '✅ PASSED' ELSE '❌ FAILED' END, '', '🔒 SECURITY ANALYSIS:', '  Score: ' || security_score || '/100', '  Risk Level: ' || risk_level, '  Findings: ' || findings,
      CASE WHEN t.n IS NOT NULL THEN concat_ws(chr(10), '', '🏗️ AUG-PDG ANALYSIS:', '  PDG Nodes: 0', '  PDG Edges: 0', '  Vulnerabilities: 0', '', '🤖 VULNERABILITY MODEL:', '  Status: RULES', '  Predictions: ' || t.n, '  Vulnerable: ' || t.v, '  High-confidence vulnerable: ' || t.hc, t.t) END,
      '', repeat('=', 80), '⚖️ FINAL DECISION: ' || final_decision, repeat('=', 80), CASE final_decision {" ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in review.VERDICTS.items())} ELSE {quoted(review.REFUSED)} END,
      CASE WHEN len(recs) > 0 THEN chr(10) || '💡 RECOMMENDATIONS:' || chr(10) || array_to_string(list_transform(recs, lambda x, i: '  ' || i || '. ' || x), chr(10)) END) AS report
    FROM whole w LEFT JOIN told t USING (file_id)""",
)
def review_text(spark, d):
    return review.review_texts(review.whole_reviews(corpus.files(spark, d), details=True))


def _failed_sql() -> str:
    """The rows of whole reviews, with components that broke off on some files."""
    bad = "bad AS (SELECT DISTINCT user_id AS file_id, user_id % 5 = 1 AS no_style, user_id % 7 = 2 AS no_scan, user_id % 9 = 4 AS no_model FROM events)"
    count = "p AS (SELECT file_id, count(*) FILTER (vulnerable) AS v, count(*) FILTER (vulnerable AND"
    joined = "FROM scores s JOIN lint l USING (file_id) JOIN p USING (file_id)"
    changes = [
        ("asked AS (", f"{bad},\nasked AS ("),
        ("FROM dedup QUALIFY row_number()", "FROM dedup WHERE file_id % 7 <> 2 QUALIFY row_number()"),
        (count, count.replace("(vulnerable", "(vulnerable AND file_id % 9 <> 4")),
        (
            f"rev AS (SELECT s.file_id, l.score AS style_score, s.score AS security_score, risk_level, findings, grave, v, hc, trunc(l.score * 0.4::DOUBLE + s.score * 0.6::DOUBLE)::INT AS overall_score {joined})",
            f"""rev AS (SELECT *, trunc(style_score * 0.4::DOUBLE + security_score * 0.6::DOUBLE)::INT AS overall_score FROM (SELECT s.file_id, no_style, no_scan, CASE WHEN no_style THEN 0 ELSE l.score END AS style_score,
      CASE WHEN no_scan THEN 50 ELSE s.score END AS security_score, CASE WHEN no_scan THEN 'UNKNOWN' ELSE risk_level END AS risk_level, CASE WHEN no_scan THEN 0 ELSE findings END AS findings, CASE WHEN no_scan THEN 0 ELSE grave END AS grave, v, hc
      {joined} JOIN bad USING (file_id)))""",
        ),
        ("CASE WHEN style_score < 70 THEN", "CASE WHEN style_score < 70 AND NOT no_style THEN"),
        ("CASE WHEN security_score < 80 THEN 'Address", "CASE WHEN no_scan THEN 'Security scanner failed - manual review required' WHEN security_score < 80 THEN 'Address"),
        ("CASE WHEN ok THEN 'SUCCESS' ELSE 'SKIPPED' END AS style_status", "CASE WHEN ok AND no_style THEN 'ERROR' WHEN ok THEN 'SUCCESS' ELSE 'SKIPPED' END AS style_status"),
        ("CASE WHEN ok THEN 'SUCCESS' ELSE 'SKIPPED' END AS security_status", "CASE WHEN ok AND no_scan THEN 'ERROR' WHEN ok THEN 'SUCCESS' ELSE 'SKIPPED' END AS security_status"),
    ]
    sql = ROWS_SQL
    for old, new in changes:
        assert old in sql, old
        sql = sql.replace(old, new, 1)
    return sql


@query("review_with_errors", f"WITH {_failed_sql()} SELECT * EXCLUDE (recs), array_to_string(recs, chr(10)) AS recommendations FROM whole")
def review_with_errors(spark, d):
    """Whole reviews of files on which a component broke off."""
    users = _table(spark, d, "events").select(F.col("user_id").alias("file_id")).distinct()
    parts = [users.filter(f"file_id % {n} = {r}").select("file_id", F.lit(c).alias("component")) for c, n, r in (("style", 5, 1), ("security", 7, 2), ("model", 9, 4))]
    df = review.whole_reviews(corpus.files(spark, d), failures=parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return df.withColumns({"recommendations": F.array_join("recommendations", "\n"), "confidence": F.round("confidence", 6)})


@query(
    "review_without_components",
    f"""WITH {_GATED_SQL} SELECT file_id, CASE WHEN ok THEN 80 ELSE 0 END AS style_score, CASE WHEN ok THEN 100 ELSE 0 END AS security_score, CASE WHEN ok THEN 92 ELSE 0 END AS overall_score, 'SKIPPED' AS style_status,
      CASE WHEN ok THEN 'APPROVE' ELSE 'REJECT' END AS final_decision FROM gate""",
)
def review_without_components(spark, d):
    df = review.whole_reviews(corpus.files(spark, d), components=())
    return df.select("file_id", "style_score", "security_score", "overall_score", "style_status", "final_decision")


_CHANGED_SQL = "changed AS (SELECT DISTINCT user_id AS file_id, 'src/x' || user_id || '.py' AS filename FROM events WHERE event_id % 7 = 0 AND user_id % 10 < 4 UNION SELECT 1000000 + nationkey, 'src/gone' || nationkey || '.py' FROM (SELECT n_nationkey AS nationkey FROM nation) WHERE nationkey < 3)"


def _change_set(spark, d):
    """Reviews of the files that a change names; three of them are not there."""
    seen = _table(spark, d, "events").filter("event_id % 7 = 0 and user_id % 10 < 4").select(F.col("user_id").alias("file_id")).distinct()
    seen = seen.select("file_id", F.concat(F.lit("src/x"), F.col("file_id").cast("string"), F.lit(".py")).alias("filename"))
    gone = _table(spark, d, "nation").filter("n_nationkey < 3").select((F.col("n_nationkey") + 1_000_000).cast("bigint").alias("file_id"), F.concat(F.lit("src/gone"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("filename"))
    return review.with_errors(review.whole_reviews(corpus.files(spark, d)), seen.unionByName(gone))


_MARK = "CASE decision " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in review.SYMBOLS.items()) + " ELSE '' END"
PR_SQL = f"""{ROWS_SQL}, {_CHANGED_SQL},
pr AS (SELECT c.file_id, c.filename, coalesce(final_decision, 'ERROR') AS decision, coalesce(overall_score, 0) AS score, coalesce(recs, []) AS recs, split_part(c.filename, '/', -1) AS base FROM changed c LEFT JOIN whole w USING (file_id)),
one AS (SELECT count(*) AS total_files, count(*) FILTER (decision <> 'ERROR') AS files_analyzed, CASE WHEN count(*) = 0 THEN 'NO_CHANGES' WHEN bool_or(decision = 'REJECT') THEN 'REJECT' WHEN bool_or(decision = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' WHEN bool_or(decision = 'REVIEW_RECOMMENDED') THEN 'REVIEW_RECOMMENDED' ELSE 'APPROVE' END AS overall_decision,
  flatten(list(list_transform(recs, lambda r: base || ': ' || r) ORDER BY file_id)) AS every, string_agg('  ' || {_MARK} || ' ' || filename || ': ' || decision || ' (Score: ' || score || '/100)', chr(10) ORDER BY file_id) AS lines,
  list({{'file': filename, 'decision': decision, 'score': score}} ORDER BY file_id) AS decisions FROM pr)"""


@query(
    "pr_report",
    f"""WITH {PR_SQL} SELECT total_files, files_analyzed, overall_decision, (overall_decision = 'REJECT')::INT AS exit_code, len(every) AS n_recommendations,
      lines || coalesce(chr(10) || array_to_string(list_transform(every[1:5], lambda x, i: '  ' || i || '. ' || x), chr(10)), '') || CASE WHEN len(every) > 5 THEN chr(10) || '  ... and ' || (len(every) - 5) || ' more' ELSE '' END AS text,
      to_json({{'pr_analysis_summary': {{'total_files': total_files, 'files_analyzed': files_analyzed, 'overall_decision': overall_decision, 'decisions': decisions, 'recommendations': every}}}})::VARCHAR AS json FROM one""",
)
def pr_report(spark, d):
    return review.change_set_report(_change_set(spark, d))


@query(
    "flow_patterns",
    f"""WITH {SCORES_SQL}, issues AS (SELECT user_id AS file_id, event_id AS id, list_sort(['v' || event_id % 11, 'w' || event_id % 3, 'a' || event_id % 5]) AS used, CASE WHEN event_id % 4 = 0 THEN [] ELSE list_sort(['d' || event_id % 7, 'c' || event_id % 2]) END AS defined, event_id % 2 = 0 AS tainted FROM events WHERE event_id % 50 = 0 OR event_id % 53 = 0),
    top AS (SELECT * FROM issues QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY id) <= 3),
    pairs AS (SELECT file_id, id, tainted, a, used[a + 1] AS source, b, defined[b + 1] AS sink FROM top, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b) WHERE b < len(defined)),
    every AS (SELECT file_id, 0 AS kind, id * 4 + a * 2 + b AS place, source, sink, CASE WHEN tainted THEN 'none' ELSE 'unknown' END AS sanitization FROM pairs
      UNION ALL (SELECT file_id, 1, line * 1000 + ord, 'user_input', c, CASE WHEN contains(lower(c), 'injection') THEN 'none' ELSE 'unknown' END FROM (SELECT *, {_CATEGORY} AS c FROM dedup QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line, ord) <= 2))
      UNION ALL SELECT DISTINCT file_id, 2, 0, 'user_input', 'system_call', 'unknown' FROM lines),
    best AS (SELECT *, min(kind) OVER (PARTITION BY file_id) AS k FROM every)
    SELECT file_id, rank, source, sink, sanitization FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY place)::INT AS rank FROM best WHERE kind = k) WHERE rank <= 2""",
)
def flow_patterns(spark, d):
    e = F.col("event_id")
    word = lambda letter, n: F.concat(F.lit(letter), (e % n).cast("string"))
    issues = _table(spark, d, "events").filter("event_id % 50 = 0 or event_id % 53 = 0").select(
        F.col("user_id").alias("file_id"), e.alias("id"), F.array(word("v", 11), word("w", 3), word("a", 5)).alias("used"),
        F.when(e % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(word("d", 7), word("c", 2))).alias("defined"), (e % 2 == 0).alias("tainted"),
    )
    return review.flow_patterns(corpus.lines(spark, d).select("file_id").distinct(), issues, _found(spark, d))


# --- two snapshots


def _snapshots(spark, d):
    """The corpus before and after: files that came, went, were changed, or moved."""
    files = corpus.files(spark, d).select("file_id", "filename", "code")
    n = F.col("file_id")
    moved = F.when(n % 11 == 4, F.concat(F.lit("moved/"), "filename")).otherwise(F.col("filename"))
    after = files.filter(n % 10 != 2).withColumns({"filename": moved, "code": F.when(n % 7 == 3, F.concat("code", F.lit("\n# more"))).otherwise(F.col("code"))})
    return files.filter(n % 10 != 1), after


_SNAPSHOT_SQL = f"""{FILES_SQL}, old AS (SELECT filename, code FROM files WHERE file_id % 10 <> 1),
new AS (SELECT file_id, CASE WHEN file_id % 11 = 4 THEN 'moved/' || filename ELSE filename END AS filename, CASE WHEN file_id % 7 = 3 THEN code || chr(10) || '# more' ELSE code END AS code FROM files WHERE file_id % 10 <> 2),
gone AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY filename) AS k FROM old WHERE filename NOT IN (SELECT filename FROM new)),
come AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY filename) AS k FROM new WHERE filename NOT IN (SELECT filename FROM old)),
diff AS (SELECT o.filename, NULL::VARCHAR AS old_filename, 'changed' AS status FROM old o JOIN new n USING (filename) WHERE o.code <> n.code
  UNION ALL SELECT c.filename, g.filename, CASE WHEN g.filename IS NULL THEN 'added' ELSE 'renamed' END FROM come c LEFT JOIN gone g ON g.code = c.code AND g.k = c.k
  UNION ALL SELECT g.filename, NULL, 'removed' FROM gone g LEFT JOIN come c ON g.code = c.code AND g.k = c.k WHERE c.filename IS NULL)"""


@query("snapshot_changes", f"WITH {_SNAPSHOT_SQL} SELECT filename, old_filename, status FROM diff")
def snapshot_changes(spark, d):
    return snapshots.changes(*_snapshots(spark, d))


_SNAPSHOT_ROWS_SQL = ROWS_SQL.replace(
    "FROM lines GROUP BY file_id)",
    "FROM lines GROUP BY file_id), every_file AS (SELECT * FROM files), " + _SNAPSHOT_SQL.replace(FILES_SQL + ", ", "").replace("FROM files", "FROM every_file") + ", review_files AS (SELECT n.file_id, n.filename, n.code FROM new n JOIN diff USING (filename) WHERE status <> 'removed')",
    1,
).replace("code AS whole, array_to_string(string_split(code, chr(10))[1:100], chr(10)) AS code,\n    split_part(trim(code, chr(32) || chr(10)), chr(10), 1) AS first FROM files)", "code AS whole, array_to_string(string_split(code, chr(10))[1:100], chr(10)) AS code,\n    split_part(trim(code, chr(32) || chr(10)), chr(10), 1) AS first FROM review_files)", 1).replace("FROM det d JOIN files f", "FROM det d JOIN review_files f", 1)


@query(
    "snapshot_decision",
    f"""WITH {_SNAPSHOT_ROWS_SQL} SELECT count(*) AS total_files, count(*) AS files_analyzed, CASE WHEN count(*) = 0 THEN 'NO_CHANGES' WHEN bool_or(final_decision = 'REJECT') THEN 'REJECT' WHEN bool_or(final_decision = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED'
      WHEN bool_or(final_decision = 'REVIEW_RECOMMENDED') THEN 'REVIEW_RECOMMENDED' ELSE 'APPROVE' END AS overall_decision, coalesce(sum(overall_score), 0)::BIGINT AS scores, coalesce(sum(findings), 0)::BIGINT AS findings FROM whole""",
)
def snapshot_decision(spark, d):
    """The change set between two snapshots, reviewed."""
    rows = review.whole_reviews(snapshots.to_review(*_snapshots(spark, d)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias
    return review.change_set(rows, total("overall_score")("scores"), total("findings")("findings")).drop("exit_code")


# --- statistics of sessions


@query(
    "session_statistics",
    """WITH e AS (SELECT 's' || user_id % 20 AS session, event_id AS seq, event_id % 61 = 0 AS reset, event_id % 4 <> 0 AS passed, event_id % 3 AS errors, event_id % 5 AS warnings, event_id % 1000 AS millis FROM events),
    c AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY session ORDER BY seq) AS stretch FROM e),
    t AS (SELECT session, stretch, count(*) FILTER (NOT reset) AS total_files, count(*) FILTER (NOT reset AND passed) AS passed_files, count(*) FILTER (NOT reset AND NOT passed) AS failed_files,
      coalesce(sum(errors) FILTER (NOT reset), 0)::BIGINT AS total_errors, coalesce(sum(warnings) FILTER (NOT reset), 0)::BIGINT AS total_warnings, coalesce(sum(millis) FILTER (NOT reset), 0)::BIGINT AS total_millis FROM c GROUP BY session, stretch)
    SELECT *, round(CASE WHEN total_files = 0 THEN 0 ELSE total_millis::DOUBLE / total_files END, 6) AS average_millis, round(CASE WHEN total_files = 0 THEN 0 ELSE passed_files * 100.0::DOUBLE / total_files END, 6) AS pass_rate FROM t""",
)
def session_statistics_query(spark, d):
    df = session_statistics.statistics(session_events(spark, d))
    return df.withColumns({c: F.round(c, 6) for c in ("average_millis", "pass_rate")})


def session_events(spark, d):
    e = F.col("event_id")
    return _table(spark, d, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("session"), e.alias("seq"), F.when(e % 61 == 0, "reset").otherwise("result").alias("kind"),
        (e % 4 != 0).alias("passed"), (e % 3).alias("errors"), (e % 5).alias("warnings"), (e % 1000).alias("millis"),
    )


# --- style results and exports


_BARE = "regexp_replace(whole, '^\\s+|\\s+$', '', 'g')"
_STYLE_CODE_SQL = "CASE file_id % 8 WHEN 0 THEN '  ' || chr(10) WHEN 1 THEN ' ab ' ELSE code END"
STYLE_SQL = (
    DETECT_SQL.replace("FROM files)", "FROM odd_files)", 1).replace(
        ", head AS (", f", odd_files AS (SELECT file_id, filename, {_STYLE_CODE_SQL} AS code FROM files), head AS (", 1
    )
    + f""", row AS (SELECT d.file_id, f.filename, f.code AS whole, language, confidence, CASE WHEN regexp_replace(f.code, '^\\s+|\\s+$', '', 'g') = '' THEN {quoted(style.NO_CODE)} WHEN length(regexp_replace(f.code, '^\\s+|\\s+$', '', 'g')) < 5 THEN {quoted(style.TOO_SHORT)} WHEN language IS NULL THEN {quoted(style.UNDETECTED)} END AS why,
    coalesce(language IN ({', '.join(map(quoted, dims.LANGUAGES))}), false) AS known FROM det d JOIN odd_files f USING (file_id)),
  src AS (SELECT file_id, generate_subscripts(string_split(whole, chr(10)), 1) AS line, language, unnest(string_split(whole, chr(10))) AS text FROM row WHERE why IS NULL AND known),
  {_over_source(ALL_ITEMS_SQL)},
  mine AS (SELECT e.*, row_number() OVER (PARTITION BY file_id, severity ORDER BY tool, line, message) AS rank FROM every e WHERE file_id IN (SELECT file_id FROM src)),
  n AS (SELECT file_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i,
    string_agg(CASE WHEN severity = 'error' AND rank <= 20 THEN '  ' || lpad(rank::VARCHAR, 2, ' ') || '. [' || tool || '] Line ' || line || ': ' || message END, chr(10) ORDER BY rank) AS et,
    string_agg(CASE WHEN severity = 'warning' AND rank <= 20 THEN '  ' || lpad(rank::VARCHAR, 2, ' ') || '. [' || tool || '] Line ' || line || ': ' || message END, chr(10) ORDER BY rank) AS wt FROM mine GROUP BY file_id),
  loc AS (SELECT file_id, count(*) FILTER (trim(text) <> '' AND NOT starts_with(trim(text), CASE WHEN language IN ('python', 'ruby') THEN '#' ELSE '//' END) AND (language <> 'php' OR coalesce(inside, 0) = 1)) AS loc
    FROM (SELECT *, last_value(CASE WHEN contains(text, '?>') THEN 0 WHEN contains(text, '<?php') OR contains(text, '<?=') THEN 1 END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM src) GROUP BY file_id),
  res AS (SELECT r.file_id, filename, CASE WHEN why IS NULL THEN language ELSE 'unknown' END AS language, CASE WHEN why IS NULL THEN round(confidence, 6) ELSE 0 END AS confidence, CASE WHEN why IS NOT NULL THEN 'ERROR' WHEN known THEN 'SUCCESS' ELSE 'WARNING' END AS status,
    why IS NULL AND (NOT known OR coalesce(e, 0) = 0) AS passed, CASE WHEN why IS NOT NULL THEN 1 ELSE coalesce(e, 0) END AS n_errors, CASE WHEN why IS NULL AND NOT known THEN 1 ELSE coalesce(w, 0) END AS n_warnings, coalesce(i, 0) AS n_infos,
    CASE WHEN why IS NOT NULL THEN 0 WHEN NOT known THEN 80 WHEN coalesce(e, 0) = 0 AND coalesce(w, 0) = 0 THEN 100 ELSE greatest(0, 100 - least(coalesce(e, 0) * 15, 70) - least(coalesce(w, 0) * 5, 25) - least(coalesce(i, 0) * 2, 5)) END::INT AS score,
    CASE WHEN why IS NULL AND NOT known THEN len(string_split(whole, chr(10))) ELSE loc END AS loc, why, known, et, wt,
    CASE WHEN why IS NULL AND known THEN coalesce(e, 0) + coalesce(w, 0) END AS complexity FROM row r LEFT JOIN n USING (file_id) LEFT JOIN loc USING (file_id))"""
)


def _style(spark, d):
    """Style results of the corpus; every eighth file is blank, the next one very short."""
    code = F.when(F.col("file_id") % 8 == 0, "  \n").when(F.col("file_id") % 8 == 1, " ab ").otherwise(F.col("code"))
    return style.style_results(corpus.files(spark, d).withColumn("code", code), tool_runs.tool_runs(spark, d))


@query("style_results", f"WITH {STYLE_SQL} SELECT file_id, filename, language, confidence, status, passed, score, n_errors, n_warnings, n_infos, loc, complexity FROM res")
def style_results(spark, d):
    return _style(spark, d).select("file_id", "filename", "language", F.round("confidence", 6).alias("confidence"), "status", "passed", "score", "n_errors", "n_warnings", "n_infos", "loc", "complexity")


_SYSTEM = f"CASE WHEN why = {quoted(style.UNDETECTED)} THEN 'detector' ELSE 'system' END"
_NOT_LISTED = quoted(style.UNSUPPORTED.split("%s")[0]) + " || language || " + quoted(style.UNSUPPORTED.split("%s")[1])


@query(
    "style_text",
    f"""WITH {STYLE_SQL} SELECT file_id, concat_ws(chr(10), repeat('=', 70), '📋 CODE STYLE ANALYSIS REPORT', repeat('=', 70), '', '📁 File: ' || filename, '🔤 Language: ' || language, '📈 Detection Confidence: ' || printf('%.1f', confidence * 100) || '%', '', '📊 SUMMARY',
      '  Status: ' || CASE WHEN passed THEN '✅ PASSED' ELSE '❌ NEEDS IMPROVEMENT' END, '  Score: ' || score || '/100', '  Errors: ' || least(n_errors, 50), '  Warnings: ' || least(n_warnings, 50), '  Info: ' || least(n_infos, 20),
      CASE WHEN loc IS NOT NULL THEN chr(10) || '📈 METRICS' END, '  Lines Of Code: ' || loc, '  Complexity: ' || complexity, CASE WHEN complexity IS NOT NULL THEN '  Maintainability: ' || score END,
      CASE WHEN n_errors > 0 THEN chr(10) || '❌ ERRORS (' || least(n_errors, 50) || '):' || chr(10) || coalesce(et, '   1. [' || {_SYSTEM} || '] Line 1: ' || why) END,
      CASE WHEN n_warnings > 0 THEN chr(10) || '⚠️  WARNINGS (' || least(n_warnings, 50) || '):' || chr(10) || coalesce(wt, '   1. [system] Line 1: ' || {_NOT_LISTED}) END, '', repeat('=', 70)) AS out FROM res""",
)
def style_text(spark, d):
    return style.exported(_style(spark, d).withColumn("confidence", F.round("confidence", 6)), "text")


@query("style_export_other", "SELECT DISTINCT user_id AS file_id, 'Unsupported format: xml' AS out FROM events")
def style_export_other(spark, d):
    return style.exported(_style(spark, d), "xml")


ORACLE_SQL["review_json"] = f"""WITH {REVIEW_SQL} SELECT file_id, to_json({{'file_id': file_id, 'style_score': style_score, 'security_score': security_score, 'risk_level': risk_level, 'overall_score': overall_score, 'overall_status': overall_status, 'final_decision': final_decision,
  'recommendations': list_filter([CASE WHEN security_score < 80 THEN 'Address security issues (score: ' || security_score || '/100)' END, CASE WHEN grave > 0 THEN 'Fix ' || grave || ' critical/high security findings' END,
    CASE WHEN hc > 0 THEN 'CRITICAL: Model detected ' || hc || ' high-confidence vulnerable patterns' WHEN v > 0 THEN 'Model detected ' || v || ' vulnerable patterns (review recommended)' END], lambda x: x IS NOT NULL)}})::VARCHAR AS json FROM dec"""
ORACLE_SQL["classifier_fit"] = "SELECT quality AS label, quality::DOUBLE AS prediction, count(*) AS n FROM labels GROUP BY quality"


# --- flows to decisions


@query(
    "code_decisions",
    f"""WITH {FILES_SQL}, x AS (SELECT file_id, filename, {" ".join(["CASE", *[f"WHEN ends_with(filename, {quoted(e)}) THEN {quoted(v)}" for e, v in dims.SIMPLE_SUFFIXES], "ELSE 'unknown' END"])} AS language,
      lower(code || CASE file_id % 4 WHEN 0 THEN ' input( os.system request.getParameter Statement.execute document.location innerHTML' WHEN 1 THEN ' input( os.system shlex.quote request.getparameter preparedstatement statement.execute document.location innerhtml textcontent' ELSE '' END) AS c FROM files),
    f AS (SELECT file_id, filename, language, CASE WHEN language = 'java' AND contains(c, 'request.getparameter') AND contains(c, 'statement.execute') THEN CASE WHEN contains(c, 'preparedstatement') THEN ['request.getParameter', 'PreparedStatement.execute', 'parameterized'] ELSE ['request.getParameter', 'Statement.execute', 'none'] END
      WHEN language = 'python' AND contains(c, 'input(') AND contains(c, 'os.system') THEN ['input()', 'os.system', CASE WHEN contains(c, 'shlex.quote') THEN 'shlex.quote' ELSE 'none' END]
      WHEN language = 'javascript' AND contains(c, 'document.location') AND contains(c, 'innerhtml') THEN CASE WHEN contains(c, 'textcontent') THEN ['document.location', 'element.textContent', 'safe'] ELSE ['document.location', 'element.innerHTML', 'none'] END
      ELSE ['internal', 'safe_operation', 'sanitized'] END AS f FROM x),
    p AS ({_PREDICTED % '(SELECT *, f[1] AS source, f[2] AS sink, f[3] AS sanitization FROM f)'})
    SELECT file_id, filename, language, source, sink, sanitization, vulnerable, confidence, CASE WHEN vulnerable AND confidence > 0.7 THEN 'BLOCK' WHEN vulnerable THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
      CASE WHEN vulnerable AND confidence > 0.7 THEN 'Block the pull request' WHEN vulnerable THEN 'Request security review' ELSE 'Allow the pull request' END AS action, CASE WHEN vulnerable AND confidence > 0.7 THEN 'HIGH' WHEN vulnerable THEN 'MEDIUM' ELSE 'LOW' END AS priority,
      CASE WHEN vulnerable AND confidence > 0.7 THEN 'High confidence vulnerability detected (confidence: ' || printf('%.3f', confidence) || ')' WHEN vulnerable THEN 'Potential vulnerability detected (confidence: ' || printf('%.3f', confidence) || ')' ELSE 'No vulnerability detected' END AS reason FROM p""",
)
def code_decisions(spark, d):
    tail = F.when(F.col("file_id") % 4 == 0, " input( os.system request.getParameter Statement.execute document.location innerHTML").when(
        F.col("file_id") % 4 == 1, " input( os.system shlex.quote request.getparameter preparedstatement statement.execute document.location innerhtml textcontent"
    )
    return flows.code_decisions(corpus.files(spark, d).withColumn("code", F.concat("code", F.coalesce(tail, F.lit("")))))


@query("classifier_predict", "SELECT quality AS label, quality = 1 AS vulnerable, quality AS predicted_class, true AS sure, count(*) AS n FROM labels GROUP BY quality")
def classifier_predict(spark, d):
    """The classifier, fitted on the training texts, predicts their own flows."""
    train = flows.training_texts(_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")))
    model = flows.fitted_classifier(train.select("text", "label"))
    part = lambda name: F.regexp_extract("text", rf"{name}: (.*)", 1)
    asked = train.select("label", part("SOURCE").alias("source"), part("SINK").alias("sink"), part("SANITIZATION").alias("sanitization"))
    out = flows.predicted(asked, model, normalize=False).withColumn("sure", F.col("confidence") >= 0.5)
    return out.groupBy(F.col("label").cast("int").alias("label"), "vulnerable", "predicted_class", "sure").agg(F.count("*").alias("n"))


@query(
    "encodings",
    f"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[^a-z0-9_\\x20\\x09-\\x0D]') AS w FROM documents),
    v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM t) GROUP BY token) QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 496),
    e AS (SELECT r, unnest(w[1:126]) AS token, unnest(range(1, 1 + len(w[1:126]))) AS i FROM t),
    x AS (SELECT r, string_agg(coalesce(id, 1)::VARCHAR, ',' ORDER BY i) AS s FROM e LEFT JOIN v USING (token) GROUP BY r)
    SELECT doc_id, concat_ws(',', '2', s, '3', CASE WHEN len(w) < 126 THEN rtrim(repeat('0,', 126 - len(w)), ',') END) AS input_ids, least(len(w), 126) + 2 AS attended FROM t LEFT JOIN x USING (r)""",
)
def encodings(spark, d):
    texts = _table(spark, d, "documents").select("doc_id", "text")
    df = training.encoded(texts, training.vocabulary(texts, 500))
    return df.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("attended"))


@query(
    "classifier_selection",
    """WITH i AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, (event_id % 3 = 0)::INT AS label FROM events), n AS (SELECT label AS said, CASE WHEN idx % 23 = 7 THEN 1 - label ELSE label END AS truth FROM i WHERE idx % 5 = 2),
    c AS (SELECT count(*) FILTER (truth = 0 AND said = 0) AS tn, count(*) FILTER (truth = 0 AND said = 1) AS fp, count(*) FILTER (truth = 1 AND said = 0) AS fn, count(*) FILTER (truth = 1 AND said = 1) AS tp FROM n)
    SELECT *, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def classifier_selection(spark, d):
    """The best of several fits, by F1 on texts that none of them saw; one label in 23 is wrong."""
    rows = flows.training_texts(_table(spark, d, "events").select(F.col("event_id").alias("doc_id"), (F.col("event_id") % 3 == 0).cast("int").alias("label")))
    rows = rows.withColumn("label", F.when(F.col("idx") % 23 == 7, 1 - F.col("label")).otherwise(F.col("label")).cast("double"))
    _, best, _ = training.best_fit(rows.filter("idx % 5 <> 2"), rows.filter("idx % 5 = 2"))
    return spark.createDataFrame([tuple(best[c] for c in ("tn", "fp", "fn", "tp", "accuracy", "f1"))], "tn bigint, fp bigint, fn bigint, tp bigint, accuracy double, f1 double")


@query("train_test_selection", "SELECT 'train' AS part, doc_id FROM (SELECT doc_id FROM labels ORDER BY doc_id, quality, toxic LIMIT 80) UNION ALL SELECT 'test', doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 0 ORDER BY doc_id, quality LIMIT 20)")
def train_test_selection(spark, d):
    labels = _table(spark, d, "labels")
    train = flows.first_rows(labels, 80, ["doc_id", "quality", "toxic"]).select(F.lit("train").alias("part"), "doc_id")
    return train.unionByName(flows.first_rows(labels.filter("toxic = 0"), 20, ["doc_id", "quality"]).select(F.lit("test").alias("part"), "doc_id"))


@query("softmax", "SELECT event_id, round(exp(a - m) / (exp(a - m) + exp(b - m)), 9) AS safe, round(exp(b - m) / (exp(a - m) + exp(b - m)), 9) AS vulnerable FROM (SELECT event_id, a, b, greatest(a, b) AS m FROM (SELECT event_id, (event_id % 17) / 4.0::DOUBLE AS a, (event_id % 23) / 5.0::DOUBLE AS b FROM events))")
def softmax(spark, d):
    p = ladders.softmax(F.array((F.col("event_id") % 17 / 4.0).cast("double"), (F.col("event_id") % 23 / 5.0).cast("double")))
    return _table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", F.round(F.get("p", F.lit(0)), 9).alias("safe"), F.round(F.get("p", F.lit(1)), 9).alias("vulnerable"))


@query(
    "label_examples",
    "WITH i AS (SELECT row_number() OVER (ORDER BY doc_id, quality) - 1 AS idx, quality AS label FROM labels) SELECT label, count(*) AS n, min(idx) AS first_idx, '[VULNERABILITY_FLOW]' || chr(10) || CASE WHEN label = 1 THEN "
    + " ELSE ".join(sql_list([f"SOURCE: {a}\nSINK: {b}\nSANITIZATION: {c}" for a, b, c in dims.FLOW_TEXTS[k]]) + "[1 + min(idx) % 6]" for k in (1, 0))
    + " END AS text FROM i GROUP BY label",
)
def label_examples(spark, d):
    texts = flows.training_texts(_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")))
    return texts.groupBy("label").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.min_by("text", "idx").alias("text"))


# --- the parser's nodes


_SOURCES = {
    "python": "def f%d(a):\n    if a:\n        return a\n    b = g(a)\n    return b\n",
    "javascript": "function f%d(a) {\n  if (a) {\n    return a;\n  }\n  let b = g(a);\n}\n",
    "ruby": "def f%d(a)\n  b = g(a)\n  return b\nend\n",
    "go": "func f%d(a int) {\n  b := g(a)\n  return b\n}\n",
    "php": "<?php\nfunction f%d($a) {\n  $b = g($a);\n  return $b;\n}\n",
    "java": "class F%d {\n  public int f(int a) {\n    return a;\n  }\n}\n",
}
#: Nodes of each type in the sources above, counted by hand.
_NODE_COUNTS = {
    "python": {"MODULE": 1, "FUNCTION_DEF": 1, "EXPRESSION": 8, "BLOCK": 2, "IF_STATEMENT": 1, "RETURN": 2, "ASSIGNMENT": 1, "CALL": 1},
    "javascript": {"MODULE": 1, "FUNCTION_DEF": 1, "EXPRESSION": 2, "BLOCK": 2, "IF_STATEMENT": 1, "RETURN": 1, "VARIABLE": 1, "CALL": 1},
    "ruby": {"MODULE": 1, "FUNCTION_DEF": 1, "EXPRESSION": 1, "BLOCK": 1, "ASSIGNMENT": 1, "CALL": 1, "RETURN": 1},
    "go": {"MODULE": 1, "FUNCTION_DEF": 1, "EXPRESSION": 1, "BLOCK": 1, "ASSIGNMENT": 1, "CALL": 1, "RETURN": 1},
    "php": {"MODULE": 1, "FUNCTION_DEF": 1, "EXPRESSION": 1, "BLOCK": 1, "ASSIGNMENT": 1, "CALL": 1, "RETURN": 1},
    "java": {"MODULE": 1, "CLASS_DEF": 1, "FUNCTION_DEF": 1, "EXPRESSION": 2, "BLOCK": 2, "RETURN": 1},
}


def _sources(spark, d):
    """A short source in each file's language, with the file's number in a name; files divisible by 11 cannot be parsed as Python."""
    text = None
    for x, code in _SOURCES.items():
        one = F.replace(F.lit(code), F.lit("%d"), F.col("file_id").cast("string"))
        text = F.when(F.col("language") == x, one) if text is None else text.when(F.col("language") == x, one)
    files = corpus.lines(spark, d).select("file_id", "language").distinct()
    return files.withColumn("code", F.when((F.col("file_id") % 11 == 0) & (F.col("language") == "python"), "def (").otherwise(text))


_PARSED = ", ".join(f"({quoted(x)}, {quoted(t)}, {n})" for x, counts in _NODE_COUNTS.items() for t, n in counts.items())


@query(
    "parsed_node_types",
    f"WITH {LINES_SQL}, f AS (SELECT DISTINCT file_id, language FROM lines), c(language, node_type, n) AS (VALUES {_PARSED}) SELECT file_id, node_type, n::BIGINT AS n FROM f JOIN c USING (language) WHERE NOT (file_id % 11 = 0 AND language = 'python') UNION ALL SELECT file_id, 'MODULE', 1 FROM f WHERE file_id % 11 = 0 AND language = 'python'",
)
def parsed_node_types(spark, d):
    return parser.node_table(parser.parsed(_sources(spark, d))).groupBy("file_id", "node_type").agg(F.count("*").alias("n"))


@query(
    "parsed_variables",
    f"""WITH {LINES_SQL}, f AS (SELECT DISTINCT file_id, language FROM lines) SELECT file_id, v AS var, k AS kind FROM f JOIN (VALUES ('python', 'def', 'a'), ('python', 'def', 'b'), ('python', 'use', 'a'), ('python', 'use', 'b'), ('python', 'use', 'g'),
      ('javascript', 'def', 'a'), ('javascript', 'def', 'b'), ('javascript', 'use', 'a'), ('ruby', 'def', 'a'), ('ruby', 'def', 'b'), ('ruby', 'use', 'a'), ('ruby', 'use', 'b'),
      ('php', 'def', 'a'), ('php', 'def', 'b'), ('php', 'use', 'a'), ('php', 'use', 'b'), ('go', 'def', 'a'), ('go', 'def', 'b'), ('go', 'use', 'a'), ('go', 'use', 'b'), ('java', 'def', 'a'), ('java', 'use', 'a')) x(l, k, v) ON l = language
    WHERE NOT (file_id % 11 = 0 AND language = 'python')""",
)
def parsed_variables(spark, d):
    _, refs = parser.code_graph(_sources(spark, d))
    return refs.filter("id = 0 and var in ('a', 'b', 'g')").select("file_id", "var", "kind")


@query("parsed_functions", f"WITH {LINES_SQL}, f AS (SELECT DISTINCT file_id, language FROM lines) SELECT file_id, CASE WHEN language = 'java' THEN 'f' ELSE 'f' || file_id END AS name FROM f WHERE NOT (file_id % 11 = 0 AND language = 'python')")
def parsed_functions(spark, d):
    nodes, _ = parser.code_graph(_sources(spark, d))
    return nodes.filter("node_type = 'FUNCTION_DEF'").select("file_id", "name")


@query("full_reviews")
def full_reviews(spark, d):
    return review.full_reviews(corpus.files(spark, d)).drop("recommendations")


@query("supported_languages", "SELECT * FROM (VALUES " + ", ".join(f"({quoted(x)}, {quoted(e)})" for x, ends in dims.EXTENSIONS.items() for e in ends) + ") t(language, extension)")
def supported_languages(spark, d):
    return detect.extensions(spark)
