"""Security scan: lines meet the rules of their language; findings are deduplicated, weighed and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims, ladders
from . import lint, rule_index


def rules(spark: SparkSession) -> DataFrame:
    """The rule dimension (97 rows); user rules are more rows of this frame."""
    rows = [(i, *r) for i, r in enumerate(dims.RULES)]
    df = spark.createDataFrame(rows, "ord int, language string, phase string, severity string, description string, regex string")
    medium = F.concat_ws("/", "language", "phase").isin(["/".join(x) for x in dims.MEDIUM_CONFIDENCE])
    return df.select(
        "*",
        F.when(medium, "MEDIUM").otherwise("HIGH").alias("confidence"),
        ladders.category(F.col("description")).alias("category"),
        ladders.remediation(F.col("description")).alias("remediation"),
        F.format_string("%s_%s_%04d", F.when(F.col("phase") == "lang", F.upper("language")).otherwise("SEC"), "severity", F.pmod(F.crc32(F.col("regex").cast("binary")), F.lit(10000))).alias("rule_id"),
        F.concat(F.lit("(?di)"), F.col("regex")).alias("pattern"),
    )


def findings(lines: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Every rule that matches a line of its language; rules are tested where a line holds the literal they require."""
    matched = F.when(F.col("phase") == "common", F.expr("regexp_extract(text, pattern, 0)")).otherwise(ladders.stripped(F.col("text")))
    return rule_index.reached(lines, rule_table).filter(F.expr("rlike(text, pattern)")).select(
        "file_id", "line", "language", "ord", "phase", "severity", "confidence", "rule_id", "description", F.substring(matched, 1, 100).alias("matched_text"), "category", "remediation"
    )


def deduplicated(found: DataFrame) -> DataFrame:
    """The first finding, in rule order, of each file, line and description."""
    first = F.row_number().over(W.partitionBy("file_id", "line", "description").orderBy("phase", "ord"))
    return found.withColumn("_r", first).filter("_r = 1").drop("_r")


def scores_with_failures(files: DataFrame, found: DataFrame, failed: DataFrame) -> DataFrame:
    """scores of files (file_id, language) with the scanner's own error rows, and error.

    failed: file_id, error, of files on which the scanner broke off: no findings, score 0, risk HIGH. A language that is not
    scanned passes with 100 and says so.
    """
    known = F.coalesce(F.col("language").isin(dims.LANGUAGES), F.lit(False))
    df = scores(files, found.join(files.filter(known), "file_id", "left_semi").join(failed, "file_id", "left_anti"))
    df = df.join(files.select("file_id", "language"), "file_id").join(failed.select("file_id", F.col("error").alias("_why")), "file_id", "left")
    broke = known & F.col("_why").isNotNull()
    error = F.when(~known, F.format_string("Unsupported language for security scan: %s", "language")).when(broke, F.concat(F.lit("Security scan failed: "), "_why"))
    given = {"score": F.lit(0), "risk_level": F.lit("HIGH"), "passed": F.lit(False)}
    return df.withColumn("error", error).withColumns({c: F.when(broke, v).otherwise(F.col(c)) for c, v in given.items()}).drop("_why", "language")


def scores(all_files: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, findings, weight, score, risk_level, passed; files without findings score 100."""
    has = [F.bool_or(F.col("severity") == s).alias(s) for s in dims.SEVERITIES]
    sums = found.groupBy("file_id").agg(F.count("*").alias("findings"), F.sum(ladders.severity_weight(F.col("severity"))).alias("weight"), *has)
    df = all_files.select("file_id").join(sums, "file_id", "left").na.fill(0, ["findings", "weight"])
    flags = {s: F.coalesce(F.col(s), F.lit(False)) for s in dims.SEVERITIES}
    df = df.select("file_id", "findings", "weight", ladders.security_score(F.col("weight")).alias("score"), ladders.risk_level(F.col("weight"), F.col("findings"), flags).alias("risk_level"))
    return df.withColumn("passed", F.col("risk_level").isin("LOW", "INFO"))


def advice(found: DataFrame) -> DataFrame:
    """The summary line of each file with findings."""
    out = None
    for s, text in dims.SUMMARY_ADVICE.items():
        hit = F.bool_or(F.col("severity") == s)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return found.groupBy("file_id").agg(out.otherwise(dims.SUMMARY_OTHER).alias("recommendation"))


def summary_maps(all_files: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, total_findings, by_severity and by_category (maps of counts, empty without findings) of every file."""

    def counted(c: str, name: str) -> DataFrame:
        n = found.groupBy("file_id", c).agg(F.count("*").alias("n"))
        return n.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))

    df = all_files.select("file_id").distinct().join(found.groupBy("file_id").agg(F.count("*").alias("total_findings")), "file_id", "left").na.fill(0, ["total_findings"])
    none = F.create_map().cast("map<string,bigint>")
    for c, name in (("severity", "by_severity"), ("category", "by_category")):
        df = df.join(counted(c, name), "file_id", "left").withColumn(name, F.coalesce(name, none))
    return df


def top_per_severity(found: DataFrame, k: int = 10) -> DataFrame:
    # on one line the rules' findings stand before the scanners'
    late = F.col("phase") == "tool" if "phase" in found.columns else F.lit(False)
    place = W.partitionBy("file_id", "severity").orderBy("line", late, "ord")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


#: Fixed value: what a scanner's plain output about eval is told as.
EVAL_USED = "eval() usage detected"
#: Headings and marks of the text report.
RULE = "=" * 70
GRAVE = ["CRITICAL", "HIGH"]


def tool_findings(runs: DataFrame) -> DataFrame:
    """Findings out of the scanners' runs (file_id, language, tool, exit_code, stdout, stderr), in the columns of findings.

    They stand after the rules' own findings (phase `tool`), in the order of the output.
    """
    out = F.when(F.col("tool") == "bandit", F.transform(lint.parse_bandit(F.col("stdout")), lambda i: _tool_finding(i["line"], i["severity"], i["confidence"], i["rule_id"], i["description"], i["matched_text"])))
    security = lambda m: _tool_finding(m["line"], m["severity"], F.lit("HIGH"), F.coalesce(m["rule"], F.lit("security-rule")), m["message"], F.lit(""))
    # output that is no JSON: its lines that speak of an error and of eval
    plain = ~F.ltrim("stdout").rlike(r"^[\[{]")
    spoken = F.filter(F.split("stdout", "\n"), lambda x: F.contains(F.lower(x), F.lit("error")) & F.contains(F.lower(x), F.lit("eval")))
    told = F.transform(spoken, lambda x: _tool_finding(F.lit(1), F.lit("CRITICAL"), F.lit("MEDIUM"), F.lit("no-eval"), F.lit(EVAL_USED), F.lit("")))
    out = out.when(F.col("tool") == "eslint", F.when(plain, told).otherwise(F.transform(lint.parse_eslint(F.col("stdout")), security)))
    vet = F.array_compact(F.transform(F.split("stderr", "\n"), lambda x: lint.parse_govet(x)))
    out = out.when(F.col("tool") == "go_vet", F.transform(vet, lambda m: _tool_finding(m["line"], m["severity"], F.lit("MEDIUM"), F.lit("go_vet"), m["message"], F.lit(""))))
    good = ~F.col("tool").isin("bandit", "eslint") | F.col("exit_code").isin(lint.GOOD_EXITS["bandit"])
    each = runs.filter(good).select("file_id", "language", "tool", F.posexplode(out).alias("ord", "f"))
    return each.select(
        "file_id", "f.line", "language", "ord", F.lit("tool").alias("phase"), "f.severity", "f.confidence", "f.rule_id", "f.description", "f.matched_text",
        ladders.category(F.col("f.description")).alias("category"), ladders.remediation(F.col("f.description")).alias("remediation"), "tool",
    )


def _tool_finding(line: Column, severity: Column, confidence: Column, rule_id: Column, description: Column, matched: Column) -> Column:
    parts = {"line": line.cast("bigint"), "severity": severity, "confidence": confidence, "rule_id": rule_id, "description": description, "matched_text": matched}
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def all_findings(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The rules' and the scanners' findings, each file, line and description once; column tool names who found it first."""
    own = findings(lines, rules(lines.sparkSession)).withColumns({"tool": F.lit("regex"), "line": F.col("line").cast("bigint")})
    return deduplicated(own.unionByName(tool_findings(runs)))


def tools_used(all_files: DataFrame, runs: DataFrame) -> DataFrame:
    """file_id, tools: the scanners that ran on each file in a usable way, or the rule scanner alone."""
    good = ~F.col("tool").isin("bandit", "eslint") | F.col("exit_code").isin(lint.GOOD_EXITS["bandit"])
    ran = runs.filter(good).groupBy("file_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    return all_files.select("file_id").join(ran, "file_id", "left").select("file_id", F.coalesce("tools", F.array(F.lit("regex"))).alias("tools"))


def report(all_files: DataFrame, found: DataFrame, used: DataFrame | None = None, k: int = 10) -> DataFrame:
    """file_id and the report text of every file: status, summary, advice, and at most k findings of each severity."""
    place = F.array_position(F.array(*[F.lit(s) for s in dims.SEVERITIES]), F.col("severity")).alias("place")
    named = found if "tool" in found.columns else found.withColumn("tool", F.lit("regex"))
    total = F.count("*").over(W.partitionBy("file_id", "severity"))
    top = top_per_severity(named.withColumn("n", total), k)
    text = F.concat(
        F.format_string("  %d. [Line %d] %s\n     Category: %s | Tool: %s", "rank", "line", "description", "category", "tool"),
        F.when(F.col("remediation") != "", F.concat(F.lit("\n     💡 Fix: "), "remediation")).otherwise(""),
    )
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\n")
    blocks = top.groupBy("file_id", "severity", place).agg(block.alias("b"), F.max("n").alias("n"))
    head = F.concat(F.lit("\n"), F.when(F.col("severity").isin(GRAVE), "⚠️ ").otherwise("🔸 "), F.col("severity"), F.lit(" SEVERITY FINDINGS:\n"))
    more = F.when(F.col("n") > k, F.format_string("\n     ... and %d more", F.col("n") - k)).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.concat(head, "b", more).alias("t"), F.format_string("    %s: %d", "severity", "n").alias("s"))))
    parts = blocks.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("details"), F.array_join(F.transform(ordered, lambda x: x["s"]), "\n").alias("counts"))
    df = scores(all_files, found).join(parts, "file_id", "left").join(advice(found), "file_id", "left")
    df = df.join(used if used is not None else tools_used(all_files, _no_runs(all_files.sparkSession)), "file_id", "left")
    none = F.col("findings") == 0
    tools = F.when(F.col("tools") == F.array(F.lit("regex")), "Regex scanner only").otherwise(F.array_join("tools", ", "))
    lines = [
        F.lit(f"🔒 SECURITY SCAN REPORT\n{RULE}\n\n📊 OVERALL STATUS:"),
        F.format_string("  Security Score: %d/100\n  Risk Level: %s", "score", "risk_level"),
        F.concat(F.lit("  Status: "), F.when(F.col("passed"), "✅ PASSED").otherwise("❌ SECURITY ISSUES DETECTED")),
        F.concat(F.lit("  Tools Used: "), tools),
        F.format_string("\n📈 SUMMARY:\n  Total Findings: %d", "findings"),
        F.when(~none, F.concat(F.lit("  Findings by Severity:\n"), "counts")),
        F.concat(F.lit("\n💡 RECOMMENDATION: "), F.coalesce("recommendation", F.lit(dims.SUMMARY_NONE))),
        F.when(none, "\n🎉 No security findings detected!").otherwise(F.col("details")),
        F.lit(f"\n{RULE}\n🔍 Scan completed. Review findings above."),
    ]
    return df.select("file_id", F.concat_ws("\n", *lines).alias("report"))


def _no_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_id bigint, language string, tool string, exit_code int, stdout string, stderr string")
