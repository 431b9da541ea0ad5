"""Packing of token sequences by non-negative least squares over length combinations.

Texts become ids and an end id; what fills a window alone is cut off first. The lengths that remain form a histogram of at
most 2,047 bins. Combinations of two to six lengths that fill a window exactly are enumerated around every bin, their
repeat counts are solved against the histogram by non-negative least squares (coordinate descent), rounded, and topped up
greedily. Pieces left over are laid head to tail, longest first, and cut where a window ends; the last window is cut into
powers of two, which need no padding. So no sequence has any.

Which piece goes where follows from its length and its rank among the pieces of that length; ranks come from counts per
task, so no step gathers all pieces of a length. The driver holds the histogram and the plan, both bounded by the window.

Defined results: null and empty texts are the end id alone; null ids are kept; repeated rows are packed each; pieces
of equal length (ties) are dealt by their rank in the written order; texts of any length are packed whole; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import broadcast_if_small, stored, table

_PIECES = "doc_id bigint, start bigint, length int, crc bigint, doc_tokens bigint, ids binary, task int, nth bigint"
_OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    end_id: int = 1
    #: Most lengths in a combination.
    depth: int = 6
    sweeps: int = 12
    #: Rows (three ints) up to which the counts per task and length are broadcast.
    broadcast_rows: int = 1_000_000


def enumerate_combinations(histogram: np.ndarray, window: int, depth: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, times), ...) that sum to the window, several for each length that occurs.

    Around each length the rest is shared out evenly: the parts are the most frequent lengths near the even share, the
    last part is what is missing, and must occur.
    """
    found: dict[tuple[tuple[int, int], ...], None] = {}
    lengths = np.flatnonzero(histogram)
    for first in lengths[::-1]:
        first = int(first)
        for parts in range(2, depth + 1):
            rest = window - first
            chosen = [first]
            for left in range(parts - 1, 1, -1):
                share = rest // left
                low, high = max(1, share - share // 4), min(window - 1, share + share // 4)
                if low > high or not histogram[low : high + 1].any():
                    break
                near = low + int(np.argmax(histogram[low : high + 1]))
                chosen.append(near)
                rest -= near
            if len(chosen) == parts - 1 and 0 < rest < window and histogram[rest]:
                values, times = np.unique([*chosen, rest], return_counts=True)
                found[tuple(zip(values.tolist(), times.tolist()))] = None
    return list(found)


def non_negative_least_squares(histogram: np.ndarray, columns: list[tuple[tuple[int, int], ...]], sweeps: int) -> np.ndarray:
    """x >= 0 that lowers ||A x - histogram||, one column of A for each combination, by coordinate descent."""
    rest = histogram.astype(float).tolist()
    norms = [sum(t * t for _, t in c) for c in columns]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        for j, c in enumerate(columns):
            step = sum(t * rest[n] for n, t in c) / norms[j]
            new = max(0.0, x[j] + step)
            if new != x[j]:
                for n, t in c:
                    rest[n] -= t * (new - x[j])
                x[j] = new
    return np.array(x)


class Plan:
    """Where the piece with the given rank among the pieces of its length goes."""

    def __init__(self, histogram: np.ndarray, params: PackParams):
        w = params.window
        columns = enumerate_combinations(histogram[:w], w, params.depth)
        solved = non_negative_least_squares(histogram[:w], columns, params.sweeps)
        left = histogram[:w].astype(np.int64).copy()
        times = np.zeros(len(columns), dtype=np.int64)
        order = np.argsort(-solved, kind="stable")
        for whole in (True, False):  # rounded down first, then as often as what is left allows
            for j in order:
                most = min(left[n] // t for n, t in columns[j])
                add = min(most, int(solved[j])) if whole else most
                times[j] += add
                for n, t in columns[j]:
                    left[n] -= t * add
        intervals, sequence, used = [], int(histogram[w]), np.zeros(w + 1, dtype=np.int64)
        if histogram[w]:
            intervals.append((w, 0, int(histogram[w]), 0, 0))
        for c, n in zip(columns, times.tolist()):
            if n:
                offset = 0
                for length, t in c:
                    for _ in range(t):
                        intervals.append((length, int(used[length]), int(used[length] + n), sequence, offset))
                        used[length] += n
                        offset += length
                sequence += n
        intervals.sort()
        self.keys = np.array([(i[0] << 44) + i[1] for i in intervals], dtype=np.int64)
        self.table = np.array(intervals, dtype=np.int64).reshape(-1, 5)
        used[w] = histogram[w]
        self.used, self.first_free = used, sequence
        tokens = left * np.arange(w)
        self.begin = np.zeros(w + 1, dtype=np.int64)
        self.begin[: w - 1] = np.cumsum(tokens[::-1])[::-1][1:]
        total = int(tokens.sum())
        full, tail = divmod(total, w)
        sizes = [1 << b for b in range(w.bit_length() - 1, -1, -1) if tail >> b & 1]
        #: Stream positions at which the sequences after the full ones begin, and the end of the stream.
        self.tail = np.cumsum([full * w, *sizes])
        self.window = w

    def cuts(self, begin: int, length: int) -> list[tuple[int, int, int]]:
        """Sequence, offset and length of the parts of a free piece that begins at that stream position."""
        out, end, full = [], begin + length, int(self.tail[0])
        while begin < end:
            if begin < full:
                k, low, high = begin // self.window, begin // self.window * self.window, (begin // self.window + 1) * self.window
            else:
                t = int(np.searchsorted(self.tail, begin, "right")) - 1
                k, low, high = full // self.window + t, int(self.tail[t]), int(self.tail[t + 1])
            n = min(end, high) - begin
            out.append((self.first_free + k, begin - low, n))
            begin += n
        return out

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, or -1 and its stream position if it is a free one (see cuts)."""
        planned = rank < self.used[length]
        sequence, offset = np.full(len(length), -1, dtype=np.int64), self.begin[length] + (rank - self.used[length]) * length
        at = np.searchsorted(self.keys, (length[planned] << 44) + rank[planned], "right") - 1
        rows = self.table[at] if len(self.table) else np.empty((0, 5), np.int64)
        sequence[planned], offset[planned] = rows[:, 3] + rank[planned] - rows[:, 1], rows[:, 4]
        return sequence, offset


def tokenized(docs: DataFrame, tokenizer: str, params: PackParams) -> DataFrame:
    """The pieces of each document before packing; ids only of those that may still be cut."""
    w, end_id = params.window, params.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.load(tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(w + 1, dtype=np.int64)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, got in zip(ids, words.encode(batch.column("text").to_pylist())):
                got = np.append(got, end_id).astype("<u4")
                for start in range(0, len(got), w):
                    part = got[start : start + w]
                    n = len(part)
                    rows.append((doc, start, n, zlib.crc32(part.tobytes()), len(got), part.tobytes() if n < w and got.max() > 65535 else part.astype("<u2").tobytes() if n < w else None, task, int(seen[n])))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = ["doc_id", "start", "length", "crc", "doc_tokens", "ids", "task", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, params: PackParams = PackParams()) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, w = docs.sparkSession, params.window
    pieces = stored(tokenized(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), params), "pieces")
    per_task = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(w + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(Plan(histogram, params))
    # a length's window has one row for each task that read documents, not one for each piece
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    bases = per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        for batch in batches:
            doc, start, length, crc, total, nth, base = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "length", "crc", "doc_tokens", "nth", "base")
            )
            ids = batch.column("doc_id")
            length = length.astype(np.int64)
            sequence, offset = plan.place(length, base + nth)
            whole = np.flatnonzero(sequence >= 0)
            cols = [c[whole] for c in (np.arange(len(length)), start, length, crc, sequence, offset)]
            parts = []
            for i in np.flatnonzero(sequence < 0):
                done, cuts = 0, plan.cuts(int(offset[i]), int(length[i]))
                raw = batch.column("ids")[int(i)].as_py() if len(cuts) > 1 else b""
                part = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * length[i] else "<u4").astype("<u4")
                for k, at, n in cuts:
                    parts.append((i, start[i] + done, n, zlib.crc32(part[done : done + n].tobytes()) if raw else crc[i], k, at))
                    done += n
            if parts:
                cols = [np.concatenate([c, np.array(m, dtype=np.int64)]) for c, m in zip(cols, zip(*parts))]
            take = pa.array(cols[0])
            arrays = [ids.take(take), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), batch.column("doc_tokens").take(take), pa.array(cols[4]), pa.array(cols[5])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = pieces.join(broadcast_if_small(bases, params.broadcast_rows), ["task", "length"])
    return joined.select("doc_id", "start", "length", "crc", "doc_tokens", "ids", "nth", "base").mapInArrow(run, _OUT)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
