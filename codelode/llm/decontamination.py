"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the stated query set. Its 3-word sequences are counted over the whole corpus, and each item keeps as seeds
the rarest of those that occur there at all, up to a share of its places (rare_share): what many texts have in common is no
seed as long as the item has something of its own. Any unchanged passage longer than the places that were left out holds a
seed. A document that holds a seed is aligned with the item around it (match 2, mismatch -1, gap -1); the alignment's score
over the item's own best score is the similarity, and it alone decides.

A benchmark of at most block_chars characters goes to every task, and the documents are read twice, to count and to match. A
larger one is never in one place: documents are read once, the sequences that may be an item's (by a bit filter of bounded
size) are written with their texts' words, counted, joined with the seeds in one shuffle, and each window meets its item in
another.

Words here are runs of letters, digits and bytes beyond ASCII; A-Z count as a-z; punctuation only separates.

Defined results: null or empty texts and items match nothing; items with fewer words than a seed are compared by
equality of that many words; rows with null ids are reported with null ids; repeated documents are reported each,
repeated items once; of alignments of equal score the first in the text is reported; texts of any length are searched
whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_skewed, stored, table
from .wordcodes import U, batch_words, grams, mix, text_batches

_SEPARATE = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _SEPARATE[_b] = 32
_FILTER_BITS = 18
_SCHEMA = "doc_id bigint, item_id bigint, score double, start bigint, end bigint"


@dataclass(frozen=True)
class LeakParams:
    seed_words: int = 3
    min_score: float = 0.55
    #: Share of an item's places that may be seeds, rarest first.
    rare_share: float = 0.6
    #: Characters of benchmark text that go to every task; a larger benchmark is joined by shuffles.
    block_chars: int = 8_000_000
    #: Bits of the filter of a larger benchmark's sequences: 2^27 are 16 MB in each task.
    filter_bits: int = 27


class ItemIndex:
    """A block of items: word codes, and the sequences of each in a sorted table."""

    def __init__(self, rows: list[tuple[int | None, str | None]], n: int):
        self.ids = [r[0] for r in rows]
        self.codes: list[np.ndarray] = []
        for _, _, data, starts in text_batches([r[1] for r in rows]):
            codes, _, _, first = batch_words(_SEPARATE[data], starts)
            self.codes += [codes[first[i] : first[i + 1]] for i in range(len(starts) - 1)]
        self.n = n
        found = [self._sequences(c) for c in self.codes]
        sizes = [len(f) for f in found]
        gram = np.concatenate([np.empty(0, U), *found])
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.repeat(np.arange(len(rows)), sizes)[order]
        self.place = np.concatenate([np.empty(0, np.int64), *[np.arange(s) for s in sizes]])[order]

    def _sequences(self, codes: np.ndarray) -> np.ndarray:
        return grams(codes, self.n)

    def keep_rare(self, counts: np.ndarray, share: float) -> None:
        """Leaves each item its rarest sequences; counts: how often each entry's sequence occurs in the corpus."""
        keep = rarest(self.item, self.gram, counts, np.array([max(0, len(c) - self.n + 1) for c in self.codes], dtype=np.int64), share)
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]

    def short(self) -> list[int]:
        return [i for i, c in enumerate(self.codes) if 0 < len(c) < self.n]


def rarest(item: np.ndarray, gram: np.ndarray, counts: np.ndarray, places: np.ndarray, share: float) -> np.ndarray:
    """Which entries are seeds: of each item's that occur, the rarest, up to that share of its places; ties by their hash."""
    order = np.lexsort((mix(gram), counts, item))
    order = order[counts[order] > 0]
    of = item[order]
    rank = np.arange(len(order)) - np.searchsorted(of, of)
    keep = np.zeros(len(item), dtype=bool)
    keep[order[rank < np.ceil(places[of] * share)]] = True
    return keep


def _bit_filter(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, dtype=bool)
    out[(codes >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
    return out


def _hits(wanted: np.ndarray, maybe: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in codes that are in the sorted wanted, and where the first equal one is there."""
    at = np.flatnonzero(maybe[(codes >> U(64 - _FILTER_BITS)).astype(np.int64)])
    found = np.searchsorted(wanted, codes[at])
    good = found < len(wanted)
    good[good] = wanted[found[good]] == codes[at][good]
    return at[good], found[good]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its window, and the window's word at which it ends."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((n, rows), dtype=U), np.full((n, cols), 1, dtype=U)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
    column = np.arange(cols, dtype=np.int32)[None, :]
    above = np.zeros((n, cols), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for r in range(rows):
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        now = np.maximum(diagonal + np.where(a[:, r, None] == b, 2, -1).astype(np.int32), above - 1)
        now = np.maximum(now, 0)
        now = np.maximum.accumulate(now + column, axis=1) - column
        at = now.argmax(axis=1)
        top = now[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = now
    return best, end


def similar(items: list[np.ndarray], windows: list[np.ndarray], min_score: float) -> Iterator[tuple[int, float, int, int]]:
    """(number, similarity, first word, end word) of the pairs that are similar enough; shapes that are alike go together."""
    order = sorted(range(len(items)), key=lambda i: len(windows[i]))
    for k in range(0, len(order), 64):
        part = order[k : k + 64]
        words, texts = [items[i] for i in part], [windows[i] for i in part]
        score, end = align(words, texts)
        good = [i for i in range(len(part)) if score[i] >= min_score * 2 * len(words[i])]
        if not good:
            continue
        ends = [int(end[i]) + 1 for i in good]
        _, length = align([words[i][::-1] for i in good], [texts[i][:e][::-1] for i, e in zip(good, ends)])
        for i, e, x in zip(good, ends, length):
            yield part[i], float(score[i]) / (2 * len(words[i])), e - int(x) - 1, e


def _candidates(index: ItemIndex, seeds: np.ndarray, places: np.ndarray, first: np.ndarray, n_codes: int) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end word) of the windows in which an item is to be aligned."""
    last = np.searchsorted(index.gram, index.gram[seeds], "right")
    times = last - seeds
    entry = np.repeat(seeds, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    place = np.repeat(places, times)
    text = np.searchsorted(first, place, "right") - 1
    item = index.item[entry]
    length = np.array([len(c) for c in index.codes])[item]
    pad = length // 2 + 4
    low = np.maximum(place - index.place[entry] - pad, first[text])
    high = np.minimum(place - index.place[entry] + length + pad, first[text + 1])
    out: list[tuple[int, int, int, int]] = []
    for k in np.lexsort((low, item, text)):
        if out and out[-1][:2] == (text[k], item[k]) and low[k] <= out[-1][3]:
            out[-1] = (*out[-1][:3], max(out[-1][3], high[k]))
        else:
            out.append((text[k], item[k], low[k], high[k]))
    return out


def _matches(docs: DataFrame, index: ItemIndex, params: LeakParams) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    n, min_score = params.seed_words, params.min_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = shared.value
        maybe = _bit_filter(items.gram)
        wanted = items.gram
        short = items.short()
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), []
            for begin, _, data, starts in text_batches(batch.column("text").to_pylist()):
                codes, word_start, word_end, first = batch_words(_SEPARATE[data], starts)
                spots = [_hits(wanted, maybe, grams(codes, n))] if len(wanted) else []
                todo = [c for places, seeds in spots for c in _candidates(items, seeds, places, first, len(codes))]
                for s in short:
                    own = items.codes[s]
                    for p in np.flatnonzero(grams(codes, len(own)) == grams(own, len(own))[0]):
                        t = int(np.searchsorted(first, p, "right") - 1)
                        if p + len(own) <= first[t + 1]:
                            todo.append((t, s, int(p), int(p + len(own))))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                found_here = similar([items.codes[c[1]] for c in todo], [codes[c[2] : c[3]] for c in todo], min_score)
                for i, value, a, e in found_here:
                    key, a, e = (int(todo[i][0]), int(todo[i][1])), a + todo[i][2], e + todo[i][2]
                    if key not in best or (value, -a) > (best[key][0], -best[key][1]):
                        best[key] = (value, a, e)
                for (t, s), (value, a, e) in sorted(best.items()):
                    text = data[starts[t] : starts[t + 1]]
                    points = lambda upto: int(((text[: upto - starts[t]] & 0xC0) != 0x80).sum())
                    found.append((ids[begin + t], items.ids[s], value, points(word_start[a]), points(word_end[e - 1])))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "item_id", "score", "start", "end"],
                )

    return docs.mapInArrow(run, _SCHEMA)


def _counted(texts: DataFrame, index: ItemIndex, n: int) -> np.ndarray:
    """How often the sequence of each entry of index occurs in the texts; a row for each distinct one goes to the driver."""
    wanted = np.unique(index.gram)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray = shared.value
        maybe, counts = _bit_filter(own), np.zeros(len(own), dtype=np.int64)
        for batch in batches:
            for _, _, data, starts in text_batches(batch.column("text").to_pylist()):
                codes, _, _, first = batch_words(_SEPARATE[data], starts)
                places, found = _hits(own, maybe, grams(codes, n))
                inside = places + n <= first[np.searchsorted(first, places, "right")]
                counts += np.bincount(found[inside], minlength=len(own))
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["entry", "n"])

    out = np.zeros(len(wanted), dtype=np.int64)
    if len(wanted):
        got = texts.select("text").mapInArrow(run, "entry bigint, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
        out[got.column("entry").to_numpy()] = got.column("n").to_numpy()
    return out[np.searchsorted(wanted, index.gram)]


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, score and code point span of the best alignment of each document and item that match."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    if chars > params.block_chars:
        return _joined_leaks(texts, items, params)
    index = ItemIndex([tuple(r) for r in items.orderBy("item_id", "text").collect()], params.seed_words)
    index.keep_rare(_counted(texts, index, params.seed_words), params.rare_share)
    return _matches(texts, index, params)


def _item_rows(items: DataFrame, n: int) -> DataFrame:
    """item (a number), item_id, codes, and the item's sequences; a short item is one sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for begin, _, data, starts in text_batches(batch.column("text").to_pylist()):
                codes, _, _, first = batch_words(_SEPARATE[data], starts)
                for i in range(len(starts) - 1):
                    own = codes[first[i] : first[i + 1]]
                    if len(own):
                        rows.append((begin + i, own.tobytes(), grams(own, min(n, len(own))).view(np.int64)))
            if rows:
                at = pa.array([r[0] for r in rows])
                lists = pa.array([r[2] for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), pa.array([r[1] for r in rows], pa.binary()), lists], names=["item", "item_id", "codes", "grams"])

    numbered = items.withColumn("item", F.monotonically_increasing_id())
    return stored(numbered.mapInArrow(run, "item bigint, item_id bigint, codes binary, grams array<bigint>"), "leak-items")


def _filter_of(rows: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of all sequences of the items, of a size that does not grow with them; tasks' bits meet in a tree."""

    def own(part: Iterator) -> Iterator[bytes]:
        held = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for row in part:
            code = np.array(row[0], dtype=np.int64).view(U) >> U(64 - bits)
            np.bitwise_or.at(held, (code >> U(3)).astype(np.int64), (U(1) << (code & U(7))).astype(np.uint8))
        yield held.tobytes()

    def both(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, dtype=np.uint8) | np.frombuffer(b, dtype=np.uint8)).tobytes()

    return np.frombuffer(rows.select("grams").rdd.mapPartitions(own).treeReduce(both), dtype=np.uint8)


def _joined_leaks(texts: DataFrame, items: DataFrame, params: LeakParams) -> DataFrame:
    """leaks() against a benchmark of any size: documents are read once, and sequences, seeds and windows meet in shuffles."""
    n, bits, spark = params.seed_words, params.filter_bits, texts.sparkSession
    item_rows = _item_rows(items, n)
    shared = spark.sparkContext.broadcast(_filter_of(item_rows, bits))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = shared.value
        for batch in batches:
            ids, numbers = batch.column("doc_id"), batch.column("row")
            for begin, _, data, starts in text_batches(batch.column("text").to_pylist()):
                codes, word_start, word_end, first = batch_words(_SEPARATE[data], starts)
                spots = []
                for size in range(1, n + 1):
                    g = grams(codes, size)
                    at = g >> U(64 - bits)
                    p = np.flatnonzero(held[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1)
                    p = p[p + size <= first[np.searchsorted(first, p, "right")]]
                    spots.append((p, g[p]))
                place, gram = (np.concatenate(c) for c in zip(*spots))
                text = np.searchsorted(first, place, "right") - 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                rows = []
                for t in np.unique(text).tolist():
                    own, a, b = text == t, first[t], first[t + 1]
                    base = points[starts[t]]
                    spans = ((points[x[a:b]] - base).astype("<i4").tobytes() for x in (word_start, word_end))
                    rows.append((begin + t, codes[a:b].tobytes(), *spans, gram[own].view(np.int64), (place[own] - a).astype(np.int32)))
                if rows:
                    at, code, first_at, end_at, found, where = zip(*rows)
                    at = pa.array(at)
                    lists = [pa.array(list(found), pa.list_(pa.int64())), pa.array(list(where), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([numbers.take(at), ids.take(at), *[pa.array(c, pa.binary()) for c in (code, first_at, end_at)], *lists], names=["row", "doc_id", "codes", "starts", "ends", "grams", "places"])

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    doc_rows = stored(numbered.mapInArrow(words, "row bigint, doc_id bigint, codes binary, starts binary, ends binary, grams array<bigint>, places array<int>"), "leak-words")
    hits = doc_rows.select("row", F.inline(F.arrays_zip("grams", "places"))).select("row", F.col("grams").alias("gram"), F.col("places").alias("at"))
    counts = hits.groupBy("gram").agg(F.count("*").alias("n"))
    length = (F.length("codes") / 8).cast("int").alias("length")
    entries = item_rows.select("item", length, F.posexplode("grams").alias("place", "gram")).join(counts, "gram")
    rank = F.row_number().over(W.partitionBy("item").orderBy("n", F.xxhash64("gram"), "place"))
    most = F.ceil((F.col("length") - (n - 1)) * params.rare_share)
    seeds = stored(entries.withColumn("rank", rank).filter((F.col("length") < n) | (F.col("rank") <= most)).drop("rank"), "leak-seeds")
    total = hits.count()
    met = join_skewed(hits, seeds, "gram", "n", total).select("row", "item", "length", (F.col("at") - F.col("place")).alias("low"))
    # a short item is found by equality: its first place stands for all
    met = met.groupBy("row", "item", "length", F.when(F.col("length") >= n, F.col("low")).alias("each")).agg(F.min("low").alias("low"))
    todo = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item", "low", "length"))).alias("todo"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                code, first_at, end_at = (np.frombuffer(batch.column(c)[i].as_py(), dtype=d) for c, d in (("codes", U), ("starts", "<i4"), ("ends", "<i4")))
                spans: list[list[int]] = []
                for t in batch.column("todo")[i].as_py():
                    pad = t["length"] // 2 + 4 if t["length"] >= n else 0
                    low, high = max(t["low"] - pad, 0), min(t["low"] + t["length"] + pad, len(code))
                    if spans and spans[-1][0] == t["item"] and low <= spans[-1][2]:
                        spans[-1][2] = max(spans[-1][2], high)
                    else:
                        spans.append([t["item"], low, high])
                for item, low, high in spans:
                    rows.append((i, item, *(x[low:high].tobytes() for x in (code, first_at, end_at))))
            if rows:
                at, item, *parts = zip(*rows)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(item, pa.int64()), *[pa.array(p, pa.binary()) for p in parts]], names=["row", "doc_id", "item", "window", "starts", "ends"])

    found = doc_rows.drop("grams", "places").join(todo, "row").mapInArrow(windows, "row bigint, doc_id bigint, item bigint, window binary, starts binary, ends binary")
    pairs = found.join(item_rows.select("item", "item_id", "codes"), "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of = lambda c, d: [np.frombuffer(x, dtype=d) for x in batch.column(c).to_pylist()]
            first_at, end_at = words_of("starts", "<i4"), words_of("ends", "<i4")
            got = [(i, v, int(first_at[i][a]), int(end_at[i][e - 1])) for i, v, a, e in similar(words_of("codes", U), words_of("window", U), params.min_score)]
            if got:
                at, *values = zip(*got)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("row", "item", "doc_id", "item_id")], pa.array(values[0]), pa.array(values[1], pa.int64()), pa.array(values[2], pa.int64())], names=["row", "item", "doc_id", "item_id", "score", "start", "end"])

    scored = pairs.select("row", "item", "doc_id", "item_id", "codes", "window", "starts", "ends").mapInArrow(score, f"row bigint, item bigint, {_SCHEMA}")
    best = F.max_by(F.struct("doc_id", "item_id", "score", "start", "end"), F.struct("score", -F.col("start"))).alias("b")
    return scored.groupBy("row", "item").agg(best).select("b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """docs less the documents that match an item; the matching ids are few longs each, the join picks its own strategy."""
    found = leaks(docs, benchmark, params).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
