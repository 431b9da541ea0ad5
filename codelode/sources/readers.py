"""Readers of source code: single files, JSON lists and whole directories."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "filename string, code string"


def read_single(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("code"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of {filename, code}; anything else is an error."""
    return json_files(spark.read.text(path, wholetext=True))


def json_files(raw: DataFrame) -> DataFrame:
    """filename and code of the items of JSON lists (column value)."""
    parsed = raw.select(F.from_json("value", "array<struct<filename:string,code:string>>").alias("items"), F.ltrim("value").startswith("[").alias("is_list"))
    checked = parsed.withColumn("items", F.when(F.col("is_list") & F.col("items").isNotNull(), F.col("items")).otherwise(F.raise_error(F.lit("expected a JSON list of files")).cast("array<struct<filename:string,code:string>>")))
    return checked.select(F.explode("items").alias("f")).select("f.filename", "f.code")


def read_directory(spark: SparkSession, root: str, endings: list[str] | None = None) -> DataFrame:
    """filename (below root) and code of the files under a folder of any file system; what is not UTF-8 is left out.

    The binary source lists and reads the files, and the JVM tells UTF-8 from other bytes. It passes over names that begin
    with _ or . (and folders of such names); those alone are listed by the driver, as they come, and read by tasks.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root).select("path", "content")
    hidden = _hidden(fs, path, top)
    if hidden:
        files = files.unionByName(spark.createDataFrame([(n,) for n in hidden], "path string").repartition(max(1, len(hidden) // 1000)).mapInArrow(_contents, "path string, content binary"))
    named = files.select(F.substring("path", len(top) + 2, 1 << 20).alias("filename"), F.col("content").cast("string").alias("code"))
    if endings:
        named = named.filter(reduce(lambda a, b: a | b, [F.col("filename").endswith(e) for e in endings]))
    return named.filter(F.is_valid_utf8("code"))


def _hidden(fs, path, top: str) -> list[str]:
    """Files that have a part below top which begins with _ or . in their name."""
    out, each = [], fs.listFiles(path, True)
    while each.hasNext():
        name = each.next().getPath().toString()
        if any(part[:1] in ("_", ".") for part in name[len(top) :].split("/")):
            out.append(name)
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("path").to_pylist():
            uri = f"file://{name.removeprefix('file:')}" if name.startswith("file:/") else name
            try:
                system, inner = pafs.FileSystem.from_uri(quote(uri, safe=":/"))
                with system.open_input_stream(inner) as f:
                    content = f.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])


#: Endings of the files that a review of changes looks at.
CHANGED_ENDINGS = [".py", ".js", ".java", ".php", ".rb", ".go", ".c", ".cpp", ".cs"]
#: Small samples of code, one of each kind a review tells apart.
SAMPLES = [
    ("clean.py", "def add(a, b):\n    return a + b\n"),
    ("shell.py", "import os\ndef run(name):\n    os.system('ls ' + name)\n"),
    ("page.js", "function show(n) {\n  document.write('<b>' + n);\n}\n"),
    ("notes.txt", "nothing to review here\n"),
]


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, _SCHEMA)


def changed_names(root: str, base: str | None = None) -> list[str]:
    """Names of the files that differ from the base branch and are still there; nothing where git cannot tell."""
    base = base or os.environ.get("GITHUB_BASE_REF") or "main"
    try:
        got = subprocess.run(["git", "diff", "--name-only", f"origin/{base}...HEAD"], cwd=root, capture_output=True, text=True, check=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return []
    return [n for n in got.stdout.splitlines() if n.endswith(tuple(CHANGED_ENDINGS)) and os.path.exists(os.path.join(root, n))]


def changed_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """The files whose filename is among names (filename) and has one of the endings."""
    wanted = names.filter(reduce(lambda a, b: a | b, [F.col("filename").endswith(e) for e in CHANGED_ENDINGS])).select("filename").distinct()
    return files.join(wanted, "filename", "left_semi")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file for review, with file_id 0; a path that is not there is an error."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return read_single(spark, path).withColumn("file_id", F.lit(0).cast("bigint"))


def tools_available() -> dict[str, bool]:
    """Which external scanners the driver can start."""
    return {name: shutil.which(name) is not None for name in ("bandit", "eslint", "go")}
