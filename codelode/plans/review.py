"""Whole reviews: scan, lint and decisions of each file, and the roll-up of a change set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ladders
from ..operators import detect, flows, graph, lint, scan
from ..session import kept
from ..sources import parser

#: Marks of the decisions in the console text.
SYMBOLS = {"APPROVE": "✅", "REVIEW_RECOMMENDED": "⚠️", "REVIEW_REQUIRED": "🔴", "REJECT": "❌"}
RANKS = {"APPROVE": 0, "REVIEW_RECOMMENDED": 1, "REVIEW_REQUIRED": 2, "REJECT": 3}


def reviewed(lines: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """file_id, style_score, security_score, risk_level, overall_score, overall_status, final_decision, recommendations.

    predictions: file_id, vulnerable, confidence (optional; files without a row have none).
    """
    found = scan.deduplicated(scan.findings(lines, scan.rules(lines.sparkSession)))
    security = scan.scores(lines.select("file_id").distinct(), found)
    style = lint.lint_results(lines).select("file_id", F.col("score").alias("style_score"))
    grave = found.groupBy("file_id").agg(F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("grave"))
    df = security.join(style, "file_id").join(grave, "file_id", "left").na.fill(0, ["grave"])
    if predictions is None:
        df = df.withColumns({"vulnerable": F.lit(0), "confident": F.lit(0)})
    else:
        sums = predictions.groupBy("file_id").agg(F.count_if("vulnerable").alias("vulnerable"), F.count_if(F.col("vulnerable") & (F.col("confidence") >= 0.85)).alias("confident"))
        df = df.join(sums, "file_id", "left").na.fill(0, ["vulnerable", "confident"])
    overall = ladders.overall_score(F.col("style_score"), F.col("score"))
    return df.select(
        "file_id", "style_score", F.col("score").alias("security_score"), "risk_level", overall.alias("overall_score"), ladders.overall_status(overall).alias("overall_status"),
        ladders.final_decision(F.col("score"), F.col("risk_level"), F.col("vulnerable"), F.col("confident")).alias("final_decision"), ladders.recommendations("score", None, None).alias("recommendations"),
    )


SAFE_FLOW = ("user_input", "system_call", "unknown")
#: Fixed values of a review: scores of a component that is not there, and the score that a failed scanner counts as.
MISSING_SCORE, FAILED_SCANNER_SCORE = 80, 50


def _first(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy("file_id").orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def flow_patterns(files: DataFrame, issues: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, rank, source, sink, sanitization: what the classifier is asked about each file, two flows at most.

    issues: file_id, id, used, defined (arrays of variables), tainted. The first three issues of a file give the pairs of
    their first two used and first two defined variables (in alphabetical order); a file without any gets flows of its
    first two findings, and without those one plain flow.
    """
    pairs = _first(issues, 3, ["id"]).select("file_id", "id", "tainted", F.posexplode(F.slice(F.array_sort("used"), 1, 2)).alias("a", "source"), "defined")
    pairs = pairs.select("file_id", "id", "tainted", "a", "source", F.posexplode(F.slice(F.array_sort("defined"), 1, 2)).alias("b", "sink"))
    from_issues = pairs.select("file_id", F.lit(0).alias("kind"), (F.col("id") * 4 + F.col("a") * 2 + F.col("b")).alias("place"), "source", "sink", F.when(F.col("tainted"), "none").otherwise("unknown").alias("sanitization"))
    from_findings = _first(found, 2, ["line", "ord"]).select(
        "file_id", F.lit(1).alias("kind"), (F.col("line") * 1000 + F.col("ord")).alias("place"), F.lit(SAFE_FLOW[0]).alias("source"), F.col("category").alias("sink"),
        F.when(F.contains(F.lower("category"), F.lit("injection")), "none").otherwise("unknown").alias("sanitization"),
    )
    plain = files.select("file_id", F.lit(2).alias("kind"), F.lit(0).alias("place"), *[F.lit(x).alias(c) for x, c in zip(SAFE_FLOW, ("source", "sink", "sanitization"))])
    every = from_issues.unionByName(from_findings).unionByName(plain)
    best = F.min("kind").over(W.partitionBy("file_id"))
    every = every.withColumn("_best", best).filter(F.col("kind") == F.col("_best"))
    return every.withColumn("rank", F.row_number().over(W.partitionBy("file_id").orderBy("place"))).filter("rank <= 2").select("file_id", "rank", "source", "sink", "sanitization")


def whole_reviews(files: DataFrame, predict=None, issues: DataFrame | Callable[[DataFrame], DataFrame] | None = None, runs: DataFrame | None = None, components: tuple[str, ...] = ("style", "security"), failures: DataFrame | None = None, watch=lambda name, df: df, details: bool = False) -> DataFrame:
    """One row for each of files (file_id, filename, code): gate, scores, decision and recommendations.

    A file whose language is unsure or not supported is rejected with score 0 and goes no further. A component that is
    not among components is SKIPPED and counts with its default score. predict adds vulnerable (boolean) and confidence to
    rows with source, sink and sanitization (flows.rule_predictions, or a fitted classifier). issues: see flow_patterns; or
    what makes them of the files that pass the gate (file_id, language, code among others), so that the gate is computed once.
    failures: file_id, component (style, security, graph or model) of components that broke off on a file; their status is
    ERROR. Style then counts as 0, security as 50 without findings, the graph gives no issues and the model no predictions.
    watch sees the rows of each stage (observed.Stages). details adds what a report of the review tells besides: style_passed,
    vulnerable, confident, and predictions (rank, source, sink, vulnerable, confidence; two at most).
    """
    gate = kept(watch("language_detection", detect.gated(files).select("file_id", "filename", "code", "language", "confidence", "status", "reason")))
    passed = gate.filter("status = 'SUPPORTED'")
    lines = passed.select("file_id", "language", F.posexplode(F.split("code", "\n", -1)).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line"), "language", "text")
    found = scan.deduplicated(scan.findings(lines, scan.rules(files.sparkSession)))
    df = passed.select("file_id")
    broke = None
    if failures is not None:
        parts = ("style", "security", "graph", "model")
        broke = kept(failures.groupBy("file_id").agg(*[F.coalesce(F.bool_or(F.col("component") == c), F.lit(False)).alias(f"{c}_broke") for c in parts]))
        lost = lambda c: broke.filter(f"{c}_broke").select("file_id")
        found = found.join(lost("security"), "file_id", "left_anti")
    if "security" in components:
        sums = found.groupBy("file_id").agg(F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("grave"))
        security = scan.scores(df, found).select("file_id", F.col("score").alias("security_score"), "risk_level", "findings")
        df = df.join(watch("security_analysis", security), "file_id").join(sums, "file_id", "left").na.fill(0, ["grave"])
    else:
        # a scanner that is not there leaves the decision's own score at 100
        df = df.withColumns({"security_score": F.lit(100), "risk_level": F.lit("UNKNOWN"), "findings": F.lit(0).cast("bigint"), "grave": F.lit(0).cast("bigint")})
        found = found.limit(0)
    if "style" in components:
        df = df.join(watch("style_analysis", lint.lint_results(lines, runs).select("file_id", F.col("score").alias("style_score"), F.col("passed").alias("style_passed"))), "file_id")
    else:
        df = df.withColumns({"style_score": F.lit(MISSING_SCORE), "style_passed": F.lit(True)})
    no_issues = files.sparkSession.createDataFrame([], "file_id bigint, id bigint, used array<string>, defined array<string>, tainted boolean")
    known = no_issues if issues is None else kept(issues(passed)) if callable(issues) else issues
    if broke is not None:
        known = known.join(lost("graph"), "file_id", "left_anti")
    df = df.join(known.groupBy("file_id").agg(F.count("*").alias("issues")), "file_id", "left").na.fill(0, ["issues"])
    asked = (predict or flows.rule_predictions)(flow_patterns(passed, known.join(passed.select("file_id"), "file_id", "left_semi"), found))
    if broke is not None:
        asked = asked.join(lost("model"), "file_id", "left_anti")
    sums = watch("vulnerability_prediction", asked).groupBy("file_id").agg(F.count_if("vulnerable").alias("vulnerable"), F.count_if(F.col("vulnerable") & (F.col("confidence") >= 0.85)).alias("confident"), F.array_sort(F.collect_list(F.struct("rank", "source", "sink", "vulnerable", "confidence"))).alias("predictions"))
    df = df.join(sums, "file_id", "left").na.fill(0, ["vulnerable", "confident"])
    no_style = no_scan = F.lit(False)
    if broke is not None:
        df = df.join(broke, "file_id", "left").na.fill(False, [f"{c}_broke" for c in parts])
        # only what is there can break off
        no_style, no_scan = (F.col(f"{c}_broke") & F.lit(c in components) for c in ("style", "security"))
        # a style that broke off is not advised on
        given = {"style_score": (no_style, F.lit(0)), "security_score": (no_scan, F.lit(FAILED_SCANNER_SCORE)), "risk_level": (no_scan, F.lit("UNKNOWN"))}
        df = df.withColumns({"_style": F.when(~no_style, F.col("style_score")), **{c: F.when(lost_one, v).otherwise(F.col(c)) for c, (lost_one, v) in given.items()}})
    said = ladders.recommendations() if broke is None else ladders.recommendations(style="_style", scanner_failed=no_scan)
    overall = ladders.overall_score(F.col("style_score"), F.col("security_score"))
    decision = ladders.final_decision(F.col("security_score"), F.col("risk_level"), F.col("vulnerable"), F.col("confident"))
    extra = {"style_passed": (F.col("style_passed") & ~no_style).alias("style_passed"), **{c: F.col(c) for c in ("vulnerable", "confident", "predictions")}} if details else {}
    df = df.select("file_id", "style_score", "security_score", "risk_level", "findings", overall.alias("overall_score"), ladders.overall_status(overall).alias("overall_status"), decision.alias("final_decision"), said.alias("recommendations"), no_style.alias("style_broke"), no_scan.alias("security_broke"), *extra.values())
    percent = F.concat(ladders.printed(F.col("confidence") * 100, 1), F.lit("%"))
    reason = F.when(F.col("reason") == "Low confidence", F.concat(F.lit("Low confidence detection ("), percent, F.lit(" < 70%)"))).otherwise(F.concat(F.lit("Unsupported language: "), F.coalesce("language", F.lit("unknown"))))
    out = gate.select("file_id", "filename", F.coalesce("language", F.lit("unknown")).alias("language"), "confidence", "status", reason.alias("why")).join(df, "file_id", "left")
    stopped = F.col("status") == "UNSUPPORTED_LANGUAGE"
    skipped = lambda name: F.when(stopped, "SKIPPED").when(F.col(f"{name}_broke"), "ERROR").otherwise("SUCCESS" if name in components else "SKIPPED").alias(f"{name}_status")
    return watch("final_decision", out).select(
        "file_id", "filename", "language", "confidence", skipped("style"), skipped("security"),
        *[F.when(stopped, 0).otherwise(F.col(c)).alias(c) for c in ("style_score", "security_score", "overall_score")],
        F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level"), F.coalesce("findings", F.lit(0)).alias("findings"),
        F.when(stopped, F.lit("UNSUPPORTED_LANGUAGE")).otherwise(F.col("overall_status")).alias("overall_status"),
        F.when(stopped, F.lit("REJECT")).otherwise(F.col("final_decision")).alias("final_decision"),
        F.when(stopped, F.array(F.concat(F.lit("Language detection failed: "), "why"))).otherwise(F.col("recommendations")).alias("recommendations"), *extra,
    )


#: Headings and closing words of a review's report.
WIDE = "=" * 80
VERDICTS = {"APPROVE": "✅ Code is SAFE to merge", "REVIEW_REQUIRED": "⚠️ Code requires SECURITY REVIEW before merging", "REVIEW_RECOMMENDED": "⚠️ Code review recommended"}
REFUSED = "❌ Code is NOT SAFE - REJECT pull request"


def review_texts(reviews: DataFrame, graphs: DataFrame | None = None, model_status: str = "RULES") -> DataFrame:
    """file_id and the report of each review (whole_reviews with details).

    graphs: file_id, nodes, edges, issues (graph.graph_stats); zeros where there is none. A file that the gate has stopped has
    neither graph nor predictions.
    """
    df = reviews
    if graphs is not None:
        df = df.join(graphs.select("file_id", "nodes", "edges", F.col("issues").alias("graph_issues")), "file_id", "left")
    for c in ("nodes", "edges", "graph_issues"):
        df = df.withColumn(c, F.coalesce(c, F.lit(0)) if c in df.columns else F.lit(0))
    stopped = F.col("overall_status") == "UNSUPPORTED_LANGUAGE"
    number = lambda i: (i + 1).cast("string")

    def prediction(p: Column, i: Column) -> Column:
        parts = [
            ("    ", number(i), ". Source: ", p["source"]), ("       Sink: ", p["sink"]), ("       Prediction: ", F.when(p["vulnerable"], "VULNERABLE").otherwise("SAFE")),
            ("       Confidence: ", ladders.printed(p["confidence"] * 100, 1), "%"), ("       High-confidence: ", F.when(p["confidence"] >= 0.85, "✅").otherwise("❌")),
        ]
        return F.concat_ws("\n", *[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in line]) for line in parts])

    verdict = F.lit(REFUSED)
    for decision, text in VERDICTS.items():
        verdict = F.when(F.col("final_decision") == decision, text).otherwise(verdict)
    said = F.transform("recommendations", lambda r, i: F.concat(F.lit("  "), number(i), F.lit(". "), r))
    blocks = [
        F.lit(f"{WIDE}\n📋 FINAL ANALYSIS REPORT\n{WIDE}"),
        F.format_string("\n🔤 Language: %s\n📁 File: %s", "language", "filename"),
        F.format_string("\n📋 STYLE ANALYSIS:\n  Score: %d/100\n  Status: %s", "style_score", F.when(F.coalesce("style_passed", F.lit(False)), "✅ PASSED").otherwise("❌ FAILED")),
        F.format_string("\n🔒 SECURITY ANALYSIS:\n  Score: %d/100\n  Risk Level: %s\n  Findings: %d", "security_score", "risk_level", "findings"),
        F.when(~stopped, F.format_string("\n🏗️ AUG-PDG ANALYSIS:\n  PDG Nodes: %d\n  PDG Edges: %d\n  Vulnerabilities: %d", "nodes", "edges", "graph_issues")),
        F.when(~stopped, F.format_string(f"\n🤖 VULNERABILITY MODEL:\n  Status: {model_status}\n  Predictions: %d\n  Vulnerable: %d\n  High-confidence vulnerable: %d", F.size("predictions"), "vulnerable", "confident")),
        F.when(F.size("predictions") > 0, F.array_join(F.transform("predictions", prediction), "\n")),
        F.format_string(f"\n{WIDE}\n⚖️ FINAL DECISION: %s\n{WIDE}", "final_decision"), verdict,
        F.when(F.size("recommendations") > 0, F.concat(F.lit("\n💡 RECOMMENDATIONS:\n"), F.array_join(said, "\n"))),
    ]
    return df.select("file_id", F.concat_ws("\n", *blocks).alias("report"))


def full_reviews(files: DataFrame, predict=None, runs: DataFrame | None = None) -> DataFrame:
    """whole_reviews with the graph's own issues: files that pass the gate are parsed and searched for taint first."""
    return whole_reviews(files, predict, lambda passed: graph.taint_issues(*parser.code_graph(passed)), runs)


def with_errors(reviews: DataFrame, changed: DataFrame) -> DataFrame:
    """A row for each file of changed (file_id, filename): its review, or a row of decision ERROR where there is none."""
    kept = [c for c in ("overall_score", "final_decision", "recommendations") if c in reviews.columns]
    df = changed.join(reviews.select("file_id", *kept), "file_id", "left")
    lost = F.col("final_decision").isNull()
    return df.withColumns(
        {
            "recommendations": F.coalesce("recommendations", F.array().cast("array<string>")),
            "overall_score": F.coalesce("overall_score", F.lit(0)),
            "final_decision": F.coalesce("final_decision", F.lit("ERROR")),
        }
    )


def change_set_report(reviews: DataFrame, shown: int = 5) -> DataFrame:
    """One row over reviews (file_id, filename, overall_score, final_decision, recommendations) of a change set.

    A change set is bounded by what one commit range names, so its rows may meet in one place: recommendations (each with
    its file's name before it, in file order), the first of them as text, decisions, and the whole as JSON.
    """
    base = F.element_at(F.split("filename", "/"), -1)
    each = reviews.withColumn("said", F.transform("recommendations", lambda r: F.concat(base, F.lit(": "), r)))
    symbol = F.element_at(F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair]), F.col("final_decision"))
    entry = F.struct("file_id", "said", F.struct(F.col("filename").alias("file"), F.col("final_decision").alias("decision"), F.col("overall_score").alias("score")).alias("d"), F.format_string("  %s %s: %s (Score: %d/100)", F.coalesce(symbol, F.lit("")), "filename", "final_decision", "overall_score").alias("line"))
    df = change_set(each, F.array_sort(F.collect_list(entry)).alias("e"))
    df = df.withColumns({"all": F.flatten(F.transform("e", lambda x: x["said"])), "decisions": F.transform("e", lambda x: x["d"]), "lines": F.transform("e", lambda x: x["line"])})
    top = F.transform(F.slice("all", 1, shown), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    more = F.when(F.size("all") > shown, F.array(F.format_string("  ... and %d more", F.size("all") - shown))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.col("lines"), top, more), "\n")
    body = F.struct("total_files", "files_analyzed", "overall_decision", "decisions", F.col("all").alias("recommendations"))
    return df.select("total_files", "files_analyzed", "overall_decision", "exit_code", F.size("all").cast("bigint").alias("n_recommendations"), text.alias("text"), F.to_json(F.struct(body.alias("pr_analysis_summary"))).alias("json"))


def change_set(reviews: DataFrame, *more: Column) -> DataFrame:
    """One row: files, files_analyzed, overall_decision (the gravest), exit_code, and the aggregates in more."""
    rank = None
    for name, r in RANKS.items():
        rank = F.when(F.col("final_decision") == name, r) if rank is None else rank.when(F.col("final_decision") == name, r)
    df = reviews.agg(F.count("*").alias("total_files"), F.count_if(F.col("final_decision") != "ERROR").alias("files_analyzed"), F.max(rank).alias("_r"), *more)
    names = F.array(*[F.lit(x) for x in RANKS])
    decision = F.when(F.col("total_files") == 0, "NO_CHANGES").otherwise(F.coalesce(F.get(names, F.col("_r")), F.lit("APPROVE")))
    df = df.withColumn("overall_decision", decision).drop("_r")
    return df.withColumn("exit_code", (F.col("overall_decision") == "REJECT").cast("int"))


def style_summary(results: DataFrame) -> DataFrame:
    """One row over lint results; zeros and 'unknown' where there are none."""
    df = results.agg(
        F.count("*").alias("total_files"), F.count_if("passed").alias("passed_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("errors", "warnings", "infos")], F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("average_score"),
    )
    status = (
        F.when(F.col("total_files") == 0, "unknown")
        .when((F.col("total_errors") == 0) & (F.col("total_warnings") == 0), "excellent")
        .when(F.col("total_errors") == 0, "good")
        .when(F.col("passed_files") == F.col("total_files"), "acceptable")
        .otherwise("needs_improvement")
    )
    rate = F.coalesce(F.round(F.try_divide(F.col("passed_files") * 100.0, F.col("total_files")), 2), F.lit(0.0))
    return df.withColumns({"failed_files": F.col("total_files") - F.col("passed_files"), "overall_status": status, "pass_rate": rate})
