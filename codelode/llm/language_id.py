"""Language identification by interpolated Kneser-Ney character models.

One model per language over character 4-grams, kept in sorted arrays of 64-bit gram codes. A text gets the language
whose model gives the lowest cross-entropy per character. A text whose entropy lies far above what that language's own
training texts have is marked as rejected (a language that was not learned, or no language at all).

Defined results: null texts and texts without a letter get `und`, score 0; rows with a null doc_id are scored but not
learned from; rows with a null lang are scored but not learned from; without any training row all is `und`; ties between
languages go to the first in alphabetical order; repeated rows are scored alike, and learned from as often as they are
there; texts of any length are scored whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_grams import Counter, KneserNey, U, gram_runs, lookup
from .common import materialized, table


@dataclass(frozen=True)
class LanguageParams:
    #: A text is rejected so many standard deviations above its language's mean entropy.
    reject_deviations: float = 5.0
    #: Characters up to which a text's length sharpens its score.
    score_chars: int = 40
    #: Bound of the table of all grams' bits in all languages; a larger one is not made, and each text's bits are then taken
    #: from the models themselves: the same figures at more time.
    table_bytes: int = 256 << 20
    #: Grams (of all languages together) up to which models are made; more are an error before any goes to the driver. A gram
    #: takes about 60 bytes there and in every executor.
    max_grams: int = 100_000_000


class LanguageModels:
    """All languages' models, with the log probabilities of all known grams in one sorted table."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], table_bytes: int = LanguageParams.table_bytes):
        self.languages = sorted(counts)
        chars = np.unique(np.concatenate([np.empty(0, U), *[np.unique(c & U(0xFFFF)) for c, _ in counts.values()]]))
        self.models = [KneserNey(*counts[x], len(chars) + 1) for x in self.languages]
        self.known = np.unique(np.concatenate([np.empty(0, U), *[c for c, _ in counts.values()]]))
        if len(self.known) * len(self.languages) * 4 > table_bytes:
            self.known = self.known[:0]
        self.bits = self._bits(self.known)
        self.limits = np.full(len(self.languages), np.inf)

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        """(grams, languages): bits each language's model needs for the gram's last character."""
        if not self.models:
            return np.zeros((len(codes), 0), dtype=np.float32)
        return np.stack([-np.log2(m.probability(codes)) for m in self.models], axis=1).astype(np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits per character, and the number of characters scored."""
        out, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for begin, codes, start, end in gram_runs(texts):
            values, at = np.unique(codes, return_inverse=True)
            place, there = lookup(self.known, values)
            bits = np.empty((len(values), len(self.languages)), dtype=np.float32)
            bits[there] = self.bits[place[there]]
            if not there.all():
                bits[~there] = self._bits(values[~there])
            length = end - start
            rows = np.flatnonzero(length > 0)
            sizes[begin : begin + len(start)] = length
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(bits[:, k][at], dtype=np.float64)])
                out[begin + rows, k] = (sums[end[rows]] - sums[start[rows]]) / length[rows]
        return out, sizes


def _held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """kind, gram, n over all rows (kind, text): summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for kind, codes, counts in counter.drain():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())],
                    names=["kind", "gram", "n"],
                )

        for batch in batches:
            kinds, texts = batch.column("kind").to_pylist(), batch.column("text").to_pylist()
            order = sorted(range(len(kinds)), key=lambda i: kinds[i])
            kinds, texts = [kinds[i] for i in order], [texts[i] for i in order]
            for begin, codes, start, end in gram_runs(texts):
                names = kinds[begin : begin + len(start)]
                cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    scored = np.zeros(end[b - 1] - start[a] + 1, dtype=np.int8)
                    np.add.at(scored, start[a:b] - start[a], 1)
                    np.add.at(scored, end[a:b] - start[a], -1)
                    inside = np.cumsum(scored[:-1]) > 0
                    counter.add(names[a], codes[start[a] : end[b - 1]][inside])
            if counter.full():
                yield from out()
        yield from out()

    counted = rows.filter("kind is not null and text is not null").select("kind", "text").mapInArrow(run, "kind string, gram bigint, n bigint")
    return counted.groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModels:
    """Models of the languages of rows (text, lang), of all grams of all of them."""
    counts = materialized(count_grams(rows.select(F.col("lang").alias("kind"), "text")))
    n_grams = counts.count()
    if n_grams > params.max_grams:
        raise ValueError(f"{n_grams} grams; models hold {params.max_grams} at most (LanguageParams.max_grams)")
    got = counts.toArrow()
    kinds = got.column("kind").combine_chunks().dictionary_encode()
    number, gram, n = kinds.indices.to_numpy(), got.column("gram").to_numpy().view(U), got.column("n").to_numpy()
    held = {}
    for i, kind in enumerate(kinds.dictionary.to_pylist()):
        own = np.flatnonzero(number == i)
        own = own[np.argsort(gram[own])]
        held[kind] = (gram[own], n[own])
    return LanguageModels(held, params.table_bytes)


def predict(docs: DataFrame, models: LanguageModels, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, lang_pred, score, entropy (bits per character), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    sharpen = params.score_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModels = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            bits, sizes = m.entropies(batch.column("text").to_pylist())
            known = (sizes > 0) & (len(m.languages) > 0)
            if len(m.languages):
                best = np.where(known, bits.argmin(axis=1), len(m.languages))
                weight = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(sizes, sharpen)[:, None])
                score = np.where(known, 1.0 / weight.sum(axis=1), 0.0)
                low = bits.min(axis=1)
                limits = np.append(m.limits, np.inf)
            else:
                best, score, low, limits = np.zeros(len(sizes), dtype=int), np.zeros(len(sizes)), np.zeros(len(sizes)), np.array([np.inf])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(names[best], pa.string()), pa.array(score), pa.array(low, mask=~known), pa.array(low > limits[best])],
                names=["doc_id", "lang", "lang_pred", "score", "entropy", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # lang only rides along, for the calibration; no prediction reads it
    return rows.mapInArrow(run, "doc_id bigint, lang string, lang_pred string, score double, entropy double, rejected boolean")


def calibrate(models: LanguageModels, rows: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModels:
    """Sets each language's rejection limit from all of its own training texts."""
    own = predict(rows, models, params).filter("lang = lang_pred").groupBy("lang")
    for r in own.agg(F.avg("entropy").alias("m"), F.coalesce(F.stddev_samp("entropy"), F.lit(0.0)).alias("s")).collect():
        models.limits[models.languages.index(r["lang"])] = r["m"] + params.reject_deviations * max(r["s"], 0.05)
    return models


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(F.col("doc_id"), 4, 2)
    training = docs.filter(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    models = calibrate(fit(training), training)
    found = predict(docs.withColumn("lang", F.lit(None).cast("string")), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")
