"""Known files, readers, invariants and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from codelode import catalog_reviews
from codelode.functions import ladders
from codelode.operators import detect, flows, scan
from codelode.plans import review, style
from codelode.sources import readers
from codelode.streaming import session_counters


def split(df):
    parts = F.posexplode(F.split("code", "\n", -1)).alias("p", "text")
    return df.select("file_id", "language", parts).select("file_id", (F.col("p") + 1).alias("line"), "language", "text")


@pytest.fixture(scope="module")
def reviews(spark):
    files = [
        (1, "python", "import os\ndef run(name):\n    cmd = name\n    os.system('ls ' + cmd)\n"),
        (2, "python", "import re\ndef clean(x):\n    return re.sub('[^a-z]', '', x)\n"),
        (3, "javascript", "function f(n) {\n  document.write('<b>' + n);\n}\n"),
    ]
    lines = split(spark.createDataFrame(files, "file_id long, language string, code string"))
    return {r["file_id"]: r for r in review.reviewed(lines).collect()}


def test_known_files(reviews):
    assert [(reviews[i]["security_score"], reviews[i]["risk_level"], reviews[i]["final_decision"]) for i in (1, 2, 3)] == [(80, "CRITICAL", "REJECT"), (100, "LOW", "APPROVE"), (90, "HIGH", "REJECT")]


@pytest.mark.parametrize(("name", "code", "want"), [
    ("test.py", "print('x')", ("python", 0.8)), ("script.js", "console.log(1);", ("javascript", 0.8)), ("a.cs", "public class A {}", (None, 0.0)),
    ("unknown.txt", "hello there all", (None, 0.0)), ("run", "#!/usr/bin/env ruby\nputs 1", ("ruby", 0.95)),
])
def test_detection(spark, name, code, want):
    r = detect.detected(spark.createDataFrame([(name, code)], "filename string, code string")).first()
    assert (r["language"], r["confidence"]) == want


def test_score_points(spark):
    df = spark.range(0, 120).select(ladders.security_score(F.col("id")).alias("s"))
    s = [r["s"] for r in df.collect()]
    assert (s[0], s[30], s[31], s[65]) == (100, 70, 68, 0) and s == sorted(s, reverse=True) and min(s) == 0
    lint = lambda e, w, i: spark.range(1).select(ladders.lint_score(F.lit(e), F.lit(w), F.lit(i))).first()[0]
    assert [lint(0, 0, 0), lint(0, 2, 0), lint(1, 0, 0), lint(10, 10, 10)] == [100, 90, 85, 0]


def test_report_counts_what_it_leaves_out(spark):
    found = spark.createDataFrame([(1, i, "HIGH", "d", i) for i in range(13)], "file_id long, line int, severity string, description string, ord int")
    found = found.withColumns({"category": F.lit("Other"), "remediation": F.lit("")})
    text = scan.report(found.select("file_id").distinct(), found).first()["report"]
    assert "    HIGH: 13\n" in text and "⚠️ HIGH SEVERITY FINDINGS:\n  1. [Line 0] d" in text and "  10. [Line 9] d" in text and "[Line 10]" not in text and "     ... and 3 more\n" in text


def test_numbers_are_printed_as_in_sql(spark):
    values = [0.0, 81.25, 86.25, 75.75, 81.35, 0.15, 0.25, 0.35, 0.8125, 0.0625, 2.0005, 99.95, 100.0, 1 / 3, 5e-324, 123456789.0625]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", *[ladders.printed(F.col("x"), n).alias(str(n)) for n in (1, 3)])
    assert [(r["1"], r["3"]) for r in df.collect()] == [(f"{x:.1f}", f"{x:.3f}") for x in values]


def test_halves_in_texts(spark, monkeypatch):
    words = ["self ", ".@Override ", "window. ", "-> ", "puts ", "error "]
    code = lambda *counts: "\n".join("." + w * n for w, n in zip(words, counts))
    # 13 and 9 of 48 points: confidences of 0.8125 and 0.5625
    files = spark.createDataFrame([(1, "a", code(13, 12, 12, 11, 0, 0)), (2, "b", code(9, 8, 8, 8, 8, 7))], "file_id long, filename string, code string")
    results = style.style_results(files)
    texts = {r["file_id"]: r["out"] for r in style.exported(results, "text").collect()}
    assert "Confidence: 81.2%\n" in texts[1] and "Confidence: 56.2%\n" in texts[2]
    stopped = review.whole_reviews(files).filter("file_id = 2").first()
    assert stopped["recommendations"] == ["Language detection failed: Low confidence detection (56.2% < 70%)"]
    said = spark.range(1).select(ladders.decision_reason(F.lit(True), F.lit(0.8125)).alias("r")).first()["r"]
    assert said == "High confidence vulnerability detected (confidence: 0.812)"
    # the query's SQL prints the confidence after it is rounded to six digits
    monkeypatch.setattr(catalog_reviews, "_style", lambda spark, d: results.filter("file_id = 1").withColumn("confidence", F.lit(0.9374999999999999)))
    assert "Confidence: 93.8%\n" in catalog_reviews.style_text(spark, "").first()["out"]


def test_flow_extraction(spark):
    code = "x = input()\nos.system(x)"
    r = spark.range(1).select(flows.extracted(F.lit(code), F.lit("python")).alias("f"), flows.extracted(F.lit(""), F.lit("go")).alias("g")).first()
    assert tuple(r["f"]) == ("input()", "os.system", "none") and tuple(r["g"]) == ("internal", "safe_operation", "sanitized")


def test_readers(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("x = 1\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "list.json").write_text(json.dumps([{"filename": "a.py", "code": "pass"}]))
    (tmp_path / "no.json").write_text('{"filename": "a.py"}')
    for name, content in {"pkg/a.PY": b"upper", "pkg/deep/x y%20.py": "é = '😀'\n".encode(), ".hidden/b.py": b"z", "_c.py": b"", "pkg/.d.py": b"\xc3(", "pkg/deep/e.pyc": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {tuple(r) for r in readers.read_directory(spark, str(tmp_path), [".py"]).collect()}
    assert got == {("pkg/__init__.py", "x = 1\n"), ("pkg/deep/x y%20.py", "é = '😀'\n"), (".hidden/b.py", "z"), ("_c.py", "")}
    assert {r["filename"] for r in readers.read_directory(spark, f"file://{tmp_path}/").collect()} == {x for x, _ in got} | {"pkg/a.PY", "pkg/deep/e.pyc", "list.json", "no.json"}
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "list.json")).collect()] == [("a.py", "pass")]
    with pytest.raises(Exception, match="JSON list"):
        readers.read_json(spark, str(tmp_path / "no.json")).collect()
    (tmp_path / "one.py").write_text("a\nb")
    assert tuple(readers.read_single(spark, str(tmp_path / "one.py")).first()) == ("one.py", "a\nb")


def test_stream_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"filename": f"f{i}.py", "code": "print(1)"}) for i in range(3)) + "\n")
    q = session_counters.running_counts(spark, str(tmp_path)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from counts").collect()] == [("python", "SUPPORTED", 3)]


def test_stages_are_observed(spark):
    from codelode.plans import observed

    files = readers.samples(spark).withColumn("file_id", F.monotonically_increasing_id()).repartition(2)
    stages = observed.Stages()
    rows = review.whole_reviews(files, watch=stages).collect()
    plain = review.whole_reviews(files).collect()
    assert sorted(rows, key=str) == sorted(plain, key=str)
    good = sum(r["style_status"] == "SUCCESS" for r in rows)
    counts = stages.rows()
    assert counts == {"language_detection": len(rows), "security_analysis": good, "style_analysis": good, "vulnerability_prediction": counts["vulnerability_prediction"], "final_decision": len(rows)}
    assert counts["vulnerability_prediction"] >= good > 0
    times = stages.times(spark).collect()
    assert [r["stage"] for r in times] == list(counts) and all(r["millis"] > 0 and r["began"] is not None for r in times)


def test_plain_scanner_output(spark):
    said = "x\nError: eval is evil\nwarning eval\nERROR no-EVAL"
    runs = spark.createDataFrame([(1, "javascript", "eslint", 1, said, ""), (2, "javascript", "eslint", 1, "all fine", ""), (3, "javascript", "eslint", 2, said, ""), (4, "javascript", "eslint", 0, "[]", "")], "file_id long, language string, tool string, exit_code int, stdout string, stderr string")
    got = [(r["file_id"], r["line"], r["severity"], r["confidence"], r["rule_id"], r["description"], r["category"]) for r in scan.tool_findings(runs).collect()]
    assert got == [(1, 1, "CRITICAL", "MEDIUM", "no-eval", "eval() usage detected", "Code Injection")] * 2


def test_summary_maps(spark):
    found = spark.createDataFrame([(1, "HIGH", "A"), (1, "HIGH", "B"), (1, "LOW", "A")], "file_id long, severity string, category string")
    rows = {r["file_id"]: (r["total_findings"], r["by_severity"], r["by_category"]) for r in scan.summary_maps(spark.range(1, 3).withColumnRenamed("id", "file_id"), found).collect()}
    assert rows == {1: (3, {"HIGH": 2, "LOW": 1}, {"A": 2, "B": 1}), 2: (0, {}, {})}


def test_renamed_files_pair_up_by_content(spark):
    from codelode.operators import snapshots

    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("same", "x"), ("d", "2"), ("n", None)], "filename string, code string")
    after = spark.createDataFrame([("y", "1"), ("z", "1"), ("same", "x"), ("d", "3"), ("e", "9"), ("m", None)], "filename string, code string")
    assert {tuple(r) for r in snapshots.changes(before, after).collect()} == {("y", "a", "renamed"), ("z", "b", "renamed"), ("c", None, "removed"), ("d", None, "changed"), ("e", None, "added"), ("m", "n", "renamed")}
    assert snapshots.changes(after, after).count() == 0 and snapshots.changes(before.limit(0), after.limit(0)).count() == 0
