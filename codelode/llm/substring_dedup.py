"""Substring deduplication by hashing of paragraphs, lines and the sentences in them.

Units are the paragraphs (lines without a blank one between), the lines, and the sentences of each line. A unit is
normalised (lower case, runs of white space to one space, outer punctuation off, in a paragraph line by line) and hashed
to 128 bits; the earliest occurrence of each digest, ranked by (rank column, doc_id, start), stays, and every later one
is removed. Spans are code points of the original text, so what was removed can always be found again. Paragraphs and
lines are units whatever their length, if anything but white space and outer punctuation is left of them. A sentence that
is only a part of its line is one from min_words words or min_chars characters (scripts without spaces) on: shorter ones
are turns of speech. A unit with the digest of the larger one around it is that one. Sentences and lines inside a removed
unit are repeats too and have rows of their own: spans nest, their union is what goes.

A passage pasted into a sentence has its first and last sentence joined to foreign words; the sentences between are
whole units and are found.

Defined results: null and empty texts have no units; null ids rank last; of units at one place in the ranking (ties) the
longer stays; rows that repeat a doc_id are one document, so equal units at the same place of both stay or go in both;
texts of any length are cut whole; empty tables give empty results; extra columns are ignored by duplicate_units and kept
by without_duplicates, whatever their names, but for one named removed, which is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_skewed, stored, table

_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")
_LINE = re.compile(r"[^\n]+")
_UNIT = re.compile(r"[^\n.!?。！？]+[.!?。！？]*")
_EDGE = " \t\r\f\v.,;:!?\"'()[]-。！？，、；：「」『』（）"


@dataclass(frozen=True)
class UnitParams:
    #: Least length of a sentence that is a part of a line; lines and paragraphs have none.
    min_words: int = 6
    #: Characters that make a sentence of fewer words long enough: text without spaces, long tokens.
    min_chars: int = 48


def _normal(text: str) -> str:
    return " ".join(text.lower().split()).strip(_EDGE)


def units_of(text: str, min_words: int, min_chars: int = UnitParams.min_chars) -> Iterator[tuple[int, int, int, bytes]]:
    """Start, end, words and digest of each unit, outer ones before those in them."""

    def unit(start: int, raw: str, normal: str, whole_line: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
        n_words = len(raw.split())
        if normal and (whole_line or n_words >= min_words or len(normal) >= min_chars):
            digest = hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            yield start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip()), n_words, digest

    for p in _PARAGRAPH.finditer(text):
        lines = [(p.start() + m.start(), m.group(), _normal(m.group())) for m in _LINE.finditer(p.group())]
        whole = "\n".join(normal for _, _, normal in lines)
        yield from unit(p.start(), p.group(), whole)
        for start, raw, normal in lines:
            if normal != whole:
                yield from unit(start, raw, normal)
            for m in _UNIT.finditer(raw):
                inner = _normal(m.group())
                if inner not in (normal, whole):
                    yield from unit(start + m.start(), m.group(), inner, False)


def units(docs: DataFrame, params: UnitParams = UnitParams(), rank: str | None = None) -> DataFrame:
    """doc_id, rank, start, end, n_words, digest of every unit."""
    least, chars = params.min_words, params.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    got = list(units_of(text, least, chars))
                    found += got
                    at += [i] * len(got)
            if found:
                cols = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                where = pa.array(at, pa.int64())
                ids = [batch.column(c).take(where) for c in ("doc_id", "rank")]
                yield pa.RecordBatch.from_arrays([*ids, *cols], names=["doc_id", "rank", "start", "end", "n_words", "digest"])

    ranked = F.col(rank).cast("double") if rank else F.lit(0.0)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), ranked.alias("rank"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, rank double, start bigint, end bigint, n_words bigint, digest binary")


def duplicate_units(docs: DataFrame, params: UnitParams = UnitParams(), rank: str | None = None) -> DataFrame:
    """One row for each removed unit: its span, and the document and span of the occurrence that stays."""
    # texts are cut into units once; what is read twice is their digests and places
    found = stored(units(docs, params, rank), "units")
    place = F.struct(F.col("rank").isNull().alias("r0"), "rank", F.col("doc_id").isNull().alias("r1"), "doc_id", "start", "end")
    # sums by digest are made before the shuffle, so a line of all documents is one row of each task
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first < last")
    first = stored(first.select("digest", "first", "n"), "first")
    later = join_skewed(found, first, "digest", "n", found.count()).filter(place > F.col("first"))
    return later.select(
        "doc_id", "start", "end", "n_words",
        F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), F.col("first.end").alias("kept_end"),
    )


def without_duplicates(docs: DataFrame, params: UnitParams = UnitParams(), rank: str | None = None) -> DataFrame:
    """docs with the removed units cut out of text; column removed keeps their original spans."""
    if "removed" in docs.columns:
        raise ValueError("docs has a column removed already")
    # spans nest: what an outer one has cut is not cut again
    before = W.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    cut = duplicate_units(docs, params, rank).select("doc_id", "start", "end").distinct().withColumn("_done", F.coalesce(F.max("end").over(before), F.lit(0).cast("bigint")))
    cut = cut.filter(F.col("end") > F.col("_done")).withColumn("start", F.greatest("start", "_done"))
    spans = cut.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    out = rows.join(spans.withColumnRenamed("doc_id", "id"), F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    text = F.col("row.text")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("removed", lambda s: s["end"]))
    stops = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    parts = F.zip_with(begins, stops, lambda b, e: F.substring(text, b.cast("int") + 1, (e - b).cast("int")))
    left = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(parts, ""))
    return out.select(*[(left if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], "removed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_units(table(spark, sf_dir, "documents"))
