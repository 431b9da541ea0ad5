"""Secret scan with corpus-wide ownership frequency (JVM expressions only).

Candidates are assignments to secret-like names, access key ids, long hexadecimal runs, and other long mixed tokens. Each
candidate value is hashed; over the whole corpus its distinct repositories and owners are counted. A value that several
owners or many repositories hold is a copied example; one of few owners and few repositories looks live. The rule-based spans stay whatever
the verdict; mixed tokens become spans (kind `owned`) only where their value looks live.

Spans are code points, end exclusive. Defined results: null text counts as empty and has no spans; all null owners count
as one owner, apart from the empty one, and so do all null repositories; null ids are kept; rows equal in doc_id and text
get equal results, those of the row once; spans that start together go by kind as listed; texts of any length are
searched whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, materialized, running_sum, table

#: The kinds in their order, each with its pattern, the group that holds the value, and the least length
#: of that value. In `assign` only the names are free of case.
KINDS = [
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("owned", r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 20),
]
BASE_KINDS = 3


@dataclass(frozen=True)
class SecretParams:
    #: A value of more owners than this is a copied example.
    max_owners: int = 2
    #: So is a value of more repositories than this, whoever owns them.
    max_repositories: int = 10


def _with_spans(df: DataFrame, k: int) -> DataFrame:
    """Adds column _k: the spans of kind k, from the lengths of the matches and of the text between them."""
    name, pattern, group, least = KINDS[k]
    df = df.withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_v", F.when(F.size("_m") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) if group else F.col("_m"))
    df = df.withColumn("_gap", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    lengths = F.zip_with(F.slice("_gap", 1, F.size("_m")), F.col("_m"), lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    df = df.withColumn("_l", lengths)
    df = df.withColumn("_at", F.when(F.size("_m") > 0, running_sum(F.col("_l"))))
    spans = F.transform(
        "_m",
        lambda m, i: F.struct(
            (F.get("_at", i) + F.length(F.get("_gap", i))).alias("start"),
            F.lit(k).alias("ord"),
            (F.get("_at", i) + F.get("_l", i)).alias("end"),
            F.xxhash64(F.get("_v", i)).alias("value"),
            F.length(F.get("_v", i)).alias("size"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,value:bigint,size:int>>")
    df = df.withColumn(f"_{k}", F.when(F.size("_m") > 0, F.filter(spans, lambda s: s["size"] >= least)).otherwise(empty))
    return df.drop("_m", "_v", "_gap", "_l", "_at")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, key (hash of the text), owner, repository, base and owned: the spans of each document, in order."""
    df = docs.select(
        "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text")
    )
    df = df.withColumn("key", F.xxhash64("text"))
    for k in range(len(KINDS)):
        df = _with_spans(df, k)
    df = df.drop("text").withColumn("base", F.sort_array(F.concat(*[f"_{k}" for k in range(BASE_KINDS)])))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("owned", F.filter(f"_{BASE_KINDS}", apart))
    return df.drop(*[f"_{k}" for k in range(len(KINDS))])


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, n_spans of every candidate value, over the whole corpus."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "owned")).alias("s"))
    # a value of many rows is summed in each task before every shuffle
    pairs = each.groupBy(F.col("s.value").alias("value"), "owner", "repository").agg(F.count("*").alias("spans"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("n"), F.sum("spans").alias("spans"))
    return owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.sum("spans").alias("n_spans"))


def secret_scan(docs: DataFrame, params: SecretParams = SecretParams(), owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, base (array of spans), spans (base and owner-specific tokens), n_live, n_copied of each document."""
    found = materialized(candidates(docs, owner, repository))
    frequency = materialized(ownership(found))
    spans = frequency.agg(F.coalesce(F.sum("n_spans"), F.lit(0))).first()[0]
    each = found.filter(F.size("base") + F.size("owned") > 0).select("doc_id", "key", F.explode(F.concat("base", "owned")).alias("s"))
    judged = join_skewed(each.withColumn("value", F.col("s.value")), frequency, "value", "n_spans", spans)
    live = (F.col("n_owners") <= params.max_owners) & (F.col("n_repositories") <= params.max_repositories)
    # a set, so a row that is there twice counts once
    per_doc = judged.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", live.alias("live"))).alias("all"))
    added = F.transform(F.filter("all", lambda x: x["live"] & (x["s"]["ord"] == BASE_KINDS)), lambda x: x["s"])
    n_live = F.size(F.filter("all", lambda x: x["live"]))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), added.alias("added"), n_live.alias("n_live"), (F.size("all") - n_live).alias("n_copied"))
    out = found.join(per_doc, found["doc_id"].eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    added = F.coalesce("added", F.slice("base", 1, F.lit(0)))
    return out.select(
        "doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_live", "n_copied")]
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["ord"] == k)).cast("bigint").alias(f"n_{KINDS[k][0]}")

    counts = [count(k) for k in range(BASE_KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_copied")
