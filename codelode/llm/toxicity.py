"""Toxicity by class-conditional Kneser-Ney character models.

A toxic and an ordinary model over character 4-grams have their own counts at the top order and back off to continuation
counts of both classes together, so a gram that one class never showed is judged by what both share. The evidence of a
word is its log-likelihood ratio. A text is described by its ratio per character, the highest ratio per character of any
8 words in a row (insults are few among many words), the highest ratio of a single word, taken as 12 nats at most (beyond
that a word is as clear as it can be), and the share of clearly toxic words; a logistic regression fitted on training rows
that the models did not see turns these four into a probability.

Defined results: null texts, empty texts and texts without letters have no evidence and get the score of the prior;
rows with a null doc_id are scored, not learned from; several labels of one doc_id count as toxic if any is; without
labels of both classes every score is 0.5; repeated rows are scored alike; a score of exactly 0.5 counts as toxic; texts
of any length are scored whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_grams import Level, ORDER, U, distinct, gram_runs, lookup
from .common import table
from .language_id import _held_out, count_grams

FEATURES = 4


@dataclass(frozen=True)
class ToxicityParams:
    #: Bound of the training sample: expected number of labelled rows that are learned from (chosen by hash of the id).
    max_labelled: int = 300_000
    window: int = 8
    clear_word: float = 3.0


class ToxicModels:
    """Log-likelihood ratios (nats) by gram, and by context for grams that neither class has."""

    def __init__(self, toxic: tuple[np.ndarray, np.ndarray], ordinary: tuple[np.ndarray, np.ndarray]):
        both, _ = distinct(np.concatenate([toxic[0], ordinary[0]]))
        p = np.full(len(both), 1.0 / (len(np.unique(both & U(0xFFFF))) + 1))
        chain, codes = [], both
        for order in range(ORDER - 1, 0, -1):
            codes, counts = distinct(codes & U((1 << (16 * order)) - 1))
            chain.append(Level(codes, counts))
        for order, level in zip(range(1, ORDER), reversed(chain)):
            p = level.mixed(both & U((1 << (16 * order)) - 1), p)
        levels = [Level(*toxic), Level(*ordinary)]
        self.grams = both
        self.ratios = np.log(levels[0].mixed(both, p) / levels[1].mixed(both, p))
        self.contexts = np.unique(both >> U(16))
        backoff = []
        for level in levels:
            at, there = lookup(level.contexts, self.contexts)
            backoff.append(np.where(there, level.discount * level.kinds[at] / level.totals[at], 1.0))
        self.context_ratios = np.log(backoff[0] / backoff[1])
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights = np.zeros(FEATURES + 1)

    def ratio(self, codes: np.ndarray) -> np.ndarray:
        at, there = lookup(self.grams, codes)
        ctx, known = lookup(self.contexts, codes >> U(16))
        return np.where(there, self.ratios[at], np.where(known, self.context_ratios[ctx], 0.0))

    def features(self, texts: list[str | None], params: ToxicityParams) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for begin, codes, start, end in gram_runs(texts):
            values, at = np.unique(codes, return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(self.ratio(values)[at])])
            # a word begins where the character before is a boundary and this one is not
            letter = (codes & U(0xFFFF)) != U(32)
            opens = np.flatnonzero(letter & ((codes >> U(16)) & U(0xFFFF) == U(32)))
            first = np.searchsorted(opens, start)
            last = np.searchsorted(opens, end)
            for i in range(len(start)):
                n = end[i] - start[i]
                a, b = first[i], last[i]
                if b <= a or n <= 0:
                    continue
                edges = np.append(opens[a:b], end[i])
                at_edge = sums[edges]
                words = np.diff(at_edge)
                span = min(params.window, b - a)
                run = (at_edge[span:] - at_edge[:-span]) / (edges[span:] - edges[:-span])
                top = words.max()
                out[begin + i] = (
                    (sums[end[i]] - sums[start[i]]) / n,
                    run.max(),
                    min(top, 12.0),
                    np.log1p((words > params.clear_word).sum() / (b - a) * 100.0),
                )
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))

    def fit_weights(self, features: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        self.mean, self.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
        x = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale])
        w, ridge = np.zeros(FEATURES + 1), np.diag([0.0, *[1.0] * FEATURES])
        for _ in range(30):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T * (p * (1 - p) + 1e-6) @ x + ridge, x.T @ (label - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def _model_rows(docs: DataFrame, models: ToxicModels, params: ToxicityParams, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicModels = shared.value
        for batch in batches:
            x = m.features(batch.column("text").to_pylist(), params)
            cols = [batch.column(c) for c in keep] + [pa.array(m.score(x))] + [pa.array(x[:, k]) for k in range(FEATURES)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", *[f"f{k}" for k in range(FEATURES)]])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["score double"] + [f"f{k} double" for k in range(FEATURES)])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicModels | None:
    """Models and weights from the labelled rows of docs (doc_id, text); None if a class is missing."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, params.max_labelled / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # at most about max_labelled rows of 12 bytes, by the line above
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    for_weights = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(4)) == 0
    counts = count_grams(rows.filter(~for_weights).select(F.col("toxic").cast("string").alias("kind"), "text"))
    got = counts.select(F.col("kind").cast("int").alias("kind"), "gram", "n").toArrow()
    kind, gram, n = (got.column(c).to_numpy() for c in ("kind", "gram", "n"))
    parts = []
    for k in (1, 0):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(gram[own].view(U))]
        parts.append((gram[own].view(U), n[own]))
    if not all(len(c) for c, _ in parts):
        return None
    models = ToxicModels(*parts)
    seen = _model_rows(rows.filter(for_weights), models, params, ["toxic"]).toArrow()
    if seen.num_rows:
        x = np.column_stack([seen.column(f"f{k}").to_numpy() for k in range(FEATURES)])
        models.fit_weights(x, seen.column("toxic").to_numpy().astype(float))
    return models


def score_texts(docs: DataFrame, models: ToxicModels | None, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if models is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    return _model_rows(rows, models, params, ["doc_id"]).select("doc_id", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _held_out(F.col("doc_id"), 5, 0)
    models = fit(docs.filter(~held_out), labels.filter(~held_out))
    found = score_texts(docs, models)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
