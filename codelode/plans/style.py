"""Style analysis of whole files: one result row each, its text report and its exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, ladders
from ..operators import detect, lint
from ..session import kept

#: What a file that is not linted is told.
NO_CODE, TOO_SHORT, UNDETECTED = "No code provided", "Code too short for analysis (minimum 5 characters)", "Could not detect programming language"
UNSUPPORTED = 'Language "%s" is not in supported list (Python, Java, JavaScript, PHP, Ruby, Go)'
_ITEMS = "array<struct<line:int,message:string,severity:string,tool:string>>"
_RULE = "=" * 70


def _one(message: Column, severity: str, tool: str) -> Column:
    return F.array(F.struct(F.lit(1).alias("line"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(tool).alias("tool")))


def style_results(files: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row for each of files (file_id, filename, code): language, confidence, status, passed, score, errors, warnings,
    info (the listed items), n_errors, n_warnings, n_infos, loc, complexity, maintainability.

    Blank, very short and undetected code is an ERROR of score 0; a language that is not supported passes with a warning
    and score 80; the rest is linted.
    """
    # detection is many expressions over the whole code: done once, and its result written
    df = kept(detect.detected(files).select("file_id", "filename", "code", "language", "confidence"))
    bare = ladders.stripped(F.coalesce("code", F.lit("")))
    why = F.when(bare == "", NO_CODE).when(F.length(bare) < 5, TOO_SHORT).when(F.col("language").isNull(), UNDETECTED)
    df = df.withColumn("why", why).withColumn("linted", F.col("why").isNull() & F.col("language").isin(dims.LANGUAGES))
    n_lines = F.size(F.split("code", "\n", -1))
    good = df.filter("linted")
    lines = good.select("file_id", "language", F.posexplode(F.split("code", "\n", -1)).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line"), "language", "text")
    mine = runs.join(good.select("file_id"), "file_id", "left_semi") if runs is not None else None
    item = F.struct(F.col("line").cast("int").alias("line"), "message", "severity", "tool")
    kinds = {"errors": "error", "warnings": "warning", "info": "info"}
    counts = {"n_errors": "error", "n_warnings": "warning", "n_infos": "info"}
    # at most LISTED items of each severity a file
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("listed") & (F.col("severity") == k), F.struct("rank", item.alias("i"))))), lambda x: x["i"]).alias(c) for c, k in kinds.items()]
    sums = lint.ranked(lint.items(lines, mine)).groupBy("file_id").agg(*lists, *[F.count_if(F.col("severity") == k).alias(c) for c, k in counts.items()])
    out = df.join(lint.lines_of_code(lines).select("file_id", "loc"), "file_id", "left").join(sums, "file_id", "left")
    n = [F.coalesce(c, F.lit(0)) for c in counts]
    linted = F.col("linted")
    scored = {"score": ladders.lint_score(*n), "passed": n[0] == 0, "complexity": n[0] + n[1]}
    out = out.withColumns({c: F.when(linted, v) for c, v in scored.items()})
    none, failed, other = F.array().cast(_ITEMS), F.col("why").isNotNull(), F.col("why").isNull() & ~F.col("linted")
    tool = F.when(F.col("why") == UNDETECTED, _one(F.col("why"), "error", "detector")).otherwise(_one(F.col("why"), "error", "system"))
    return out.select(
        "file_id", "filename",
        F.when(failed, "unknown").otherwise(F.col("language")).alias("language"),
        F.when(failed, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(failed, "ERROR").when(other, "WARNING").otherwise("SUCCESS").alias("status"),
        F.when(failed, False).when(other, True).otherwise(F.col("passed")).alias("passed"),
        F.when(failed, 0).when(other, 80).otherwise(F.col("score")).alias("score"),
        F.when(failed, tool).otherwise(F.coalesce("errors", none)).cast(_ITEMS).alias("errors"),
        F.when(other, _one(F.format_string(UNSUPPORTED, "language"), "warning", "system")).otherwise(F.coalesce("warnings", none)).cast(_ITEMS).alias("warnings"),
        F.coalesce("info", none).alias("info"),
        F.when(failed, 1).otherwise(F.coalesce("n_errors", F.lit(0))).cast("bigint").alias("n_errors"),
        F.when(other, 1).otherwise(F.coalesce("n_warnings", F.lit(0))).cast("bigint").alias("n_warnings"),
        F.coalesce("n_infos", F.lit(0)).cast("bigint").alias("n_infos"),
        F.when(other, n_lines).otherwise(F.col("loc")).cast("bigint").alias("loc"),
        F.col("complexity"), F.when(F.col("linted"), F.col("score")).alias("maintainability"),
    )


def formatted(results: DataFrame, detailed: bool = False, shown: int = 20) -> Column:
    """The text report of a result row; detailed adds its first errors and warnings."""

    def block(head: str, name: str) -> Column:
        each = F.transform(F.slice(name, 1, shown), lambda x, i: F.concat(F.lit("  "), F.lpad((i + 1).cast("string"), 2, " "), F.lit(". ["), x["tool"], F.lit("] Line "), x["line"].cast("string"), F.lit(": "), x["message"]))
        return F.when(F.size(name) > 0, F.concat(F.format_string(f"\n{head} (%d):\n", F.size(name)), F.array_join(each, "\n")))

    metrics = [F.when(F.col(c).isNotNull(), F.concat(F.lit("  "), ladders.title(F.lit(n)), F.lit(": "), F.col(c).cast("string"))) for c, n in (("loc", "lines_of_code"), ("complexity", "complexity"), ("maintainability", "maintainability"))]
    parts = [
        F.lit(f"{_RULE}\n📋 CODE STYLE ANALYSIS REPORT\n{_RULE}"),
        F.format_string("\n📁 File: %s\n🔤 Language: %s\n📈 Detection Confidence: %s%%", "filename", "language", ladders.printed(F.col("confidence").cast("double") * 100, 1)),
        F.concat(F.lit("\n📊 SUMMARY\n  Status: "), F.when(F.col("passed"), "✅ PASSED").otherwise("❌ NEEDS IMPROVEMENT")),
        F.format_string("  Score: %d/100\n  Errors: %d\n  Warnings: %d\n  Info: %d", "score", F.size("errors"), F.size("warnings"), F.size("info")),
        F.when(F.col("loc").isNotNull(), F.lit("\n📈 METRICS")), *metrics,
        *([block("❌ ERRORS", "errors"), block("⚠️  WARNINGS", "warnings")] if detailed else []),
        F.lit(f"\n{_RULE}"),
    ]
    return F.concat_ws("\n", *parts)


def exported(results: DataFrame, kind: str = "json") -> DataFrame:
    """file_id and out: each result as JSON or as its detailed text; any other kind gives the message that says so."""
    if kind == "json":
        out = F.to_json(F.struct(*results.columns))
    elif kind == "text":
        out = formatted(results, detailed=True)
    else:
        out = F.lit(f"Unsupported format: {kind}")
    return results.select("file_id", out.alias("out"))
