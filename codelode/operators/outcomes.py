"""What became of the tools that were to run: a matrix of expected runs, and what each outcome means for a file.

Every file is to be run through the tools of its language. Runs: file_id, tool, exit_code (null if it was stopped at its time
limit), stdout, stderr. A run that is not there is of a tool that could not be started.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lint

#: The tools of each language in the order in which they run, and their time limits in seconds.
EXPECTED = {
    "python": {"pylint": 30, "flake8": 10},
    "javascript": {"eslint": 15, "jshint": 10},
    "java": {"javac": 20},
    "php": {"php": 10},
    "ruby": {"ruby": 10},
    "go": {"gofmt": 10, "go": 20},
}
#: Tools whose failure is a warning, by the name it is told under; jshint's is told nowhere.
TOLD = {"pylint": "pylint", "flake8": "flake8", "eslint": "ESLint"}
SILENT = ["jshint"]
LATE = "Linter timeout - code too complex"
_JSON = ["eslint", "jshint"]


def expected(files: DataFrame) -> DataFrame:
    """file_id, tool, place, limit: the runs that files (file_id, language) are to have."""
    tools = None
    for language, own in EXPECTED.items():
        each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("tool"), F.lit(s).alias("limit")) for i, (t, s) in enumerate(own.items())])
        tools = F.when(F.col("language") == language, each) if tools is None else tools.when(F.col("language") == language, each)
    return files.select("file_id", F.explode(tools).alias("t")).select("file_id", "t.tool", "t.place", "t.limit")


def outcomes(files: DataFrame, runs: DataFrame) -> DataFrame:
    """file_id, tool, place, limit, outcome of every expected run: ran, bad_exit, unreadable, late or missing."""
    bad = F.lit(False)
    for tool, codes in lint.GOOD_EXITS.items():
        bad = bad | ((F.col("tool") == tool) & ~F.col("exit_code").isin(codes))
    plain = F.col("tool").isin(_JSON) & (F.trim("stdout") != "") & ~F.ltrim("stdout").startswith("[")
    df = expected(files).join(runs.select("file_id", "tool", "exit_code", "stdout", F.lit(True).alias("_ran")), ["file_id", "tool"], "left")
    outcome = F.when(F.col("_ran").isNull(), "missing").when(F.col("exit_code").isNull(), "late").when(bad, "bad_exit").when(plain, "unreadable").otherwise("ran")
    return df.select("file_id", "tool", "place", "limit", outcome.alias("outcome"))


def _why() -> Column:
    missing = F.format_string("[Errno 2] No such file or directory: '%s'", "tool")
    return F.when(F.col("outcome") == "missing", missing).otherwise(F.format_string("timed out after %d seconds", "limit"))


def failure_items(found: DataFrame) -> DataFrame:
    """file_id, tool, line, severity, message: the warnings of tools that failed beside others of their language."""
    name = F.element_at(F.create_map(*[F.lit(x) for pair in TOLD.items() for x in pair]), F.col("tool"))
    failed = found.filter(F.col("outcome").isin("missing", "late") & F.col("tool").isin(list(TOLD)))
    return failed.select("file_id", "tool", F.lit(1).alias("line"), F.lit("warning").alias("severity"), F.concat(name, F.lit(" failed: "), _why()).alias("message"))


def failed_files(found: DataFrame) -> DataFrame:
    """file_id, message: files of the other languages, whose linting ends with the first of their tools that fails."""
    failed = found.filter(F.col("outcome").isin("missing", "late") & ~F.col("tool").isin([*TOLD, *SILENT]))
    first = F.row_number().over(W.partitionBy("file_id").orderBy("place"))
    message = F.when(F.col("outcome") == "late", LATE).otherwise(F.concat(F.lit("Linter failed: "), _why()))
    return failed.withColumn("_k", first).filter("_k = 1").select("file_id", message.alias("message"))


def lint_results(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """lint.lint_results with what did not run: a failed file has one error, score 0 and no metrics; error is its message."""
    files = lines.select("file_id", "language").distinct()
    found = outcomes(files, runs)
    # what a stopped run has printed is not read
    done = runs.filter("exit_code is not null")
    results = lint.lint_results(lines, done, failure_items(found))
    df = results.join(failed_files(found).withColumnRenamed("message", "error"), "file_id", "left")
    failed = F.col("error").isNotNull()
    given = {"errors": 1, "warnings": 0, "infos": 0, "score": 0, "passed": False, "complexity": 0}
    return df.withColumns({c: F.when(failed, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in given.items()})
