"""What a review does once: gate, parsing in frames of many files, and both tables of the taint analysis."""

import random

import pandas as pd
from pyspark.sql import functions as F

from codelode.operators import detect, graph, intervals
from codelode.plans import review
from codelode.sources import parser, readers


def test_the_gate_is_computed_once(spark, monkeypatch):
    asked, gated = [], detect.gated
    monkeypatch.setattr(detect, "gated", lambda files, *a: asked.append(1) or gated(files, *a))
    files = readers.samples(spark).withColumn("file_id", F.monotonically_increasing_id())
    assert review.full_reviews(files).count() == files.count() and len(asked) == 1


def test_issues_of_the_files_that_pass(spark):
    files = spark.createDataFrame([(1, "a.py", "import os\nname = input()\nos.system(name)\n"), (2, "b.xyz", "plain words")], "file_id long, filename string, code string")
    seen = []

    def issues(passed):
        seen.extend(r["file_id"] for r in passed.collect())
        return passed.select("file_id", F.lit(1).cast("bigint").alias("id"), F.array(F.lit("name")).alias("used"), F.array(F.lit("x")).alias("defined"), F.lit(True).alias("tainted"))

    rows = {r["file_id"]: r for r in review.whole_reviews(files, issues=issues, details=True).collect()}
    assert seen == [1] and [(p["source"], p["sink"]) for p in rows[1]["predictions"]] == [("name", "x")] and rows[2]["overall_status"] == "UNSUPPORTED_LANGUAGE"


def test_taint_makes_its_tables_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(kind):
        made.add(1)
        return kind

    nodes = spark.createDataFrame([(1, i, None, i, 0, i + 1, 0, t, "n", c, "python", False) for i, (t, c) in enumerate([("CALL", "x = input()"), ("ASSIGNMENT", "y = x"), ("CALL", "os.system(y)")])], "file_id long, id long, parent_id long, last_id long, depth int, line long, col long, node_type string, name string, code string, language string, is_condition boolean")
    refs = spark.createDataFrame([(1, 0, "x", "def"), (1, 1, "y", "def"), (1, 1, "x", "use"), (1, 2, "y", "use")], "file_id long, id long, var string, kind string")
    issues = graph.taint_issues(nodes, refs.withColumn("kind", told("kind"))).collect()
    assert [(r["id"], r["defined"], r["used"]) for r in issues] == [(2, [], ["y"])] and made.value == 4


def test_frames_of_many_files(monkeypatch):
    files = pd.DataFrame([(i, "javascript", f"let a{i} = {i};\n") for i in range(10)], columns=["file_id", "language", "code"])
    whole = list(parser._parsed_frames(iter([files])))
    assert len(whole) == 1 and whole[0]["file_id"].nunique() == 10
    for limit in ("_HELD_ROWS", "_HELD_CHARS"):
        with monkeypatch.context() as m:
            m.setattr(parser, limit, 1)
            assert pd.concat(parser._parsed_frames(iter([files])), ignore_index=True).equals(whole[0]) and len(list(parser._parsed_frames(iter([files])))) == 10


def test_least_depth_of_ranges(spark):
    dice = random.Random(3)
    depths = [0] + [dice.randint(1, 9) for _ in range(130)]
    ranges = [(1, i, *sorted((dice.randrange(131), dice.randrange(131)))) for i in range(300)] + [(1, 300 + i, i, i) for i in range(131)] + [(1, 500, 0, 130), (1, 501, 0, 127), (1, 502, 1, 128), (1, 503, 64, 127)]
    nodes = spark.createDataFrame([(1, i, d) for i, d in enumerate(depths)], "file_id long, id long, depth int")
    got = intervals._least_depth(nodes, spark.createDataFrame(ranges, "file_id long, id long, lo long, hi long"), ["id"]).collect()
    assert {r["id"]: r["least"] for r in got} == {i: min(depths[lo : hi + 1]) for _, i, lo, hi in ranges}
