"""MinHash near-duplicates by a multi-index Hamming join.

Each text becomes the set of its 5-word shingles and a signature of 64 MinHash values of 16 bits. Two sets of Jaccard
similarity s differ in a value with chance 1 - s, so at s = 0.75 more than 31 of 64 differ with a chance near 1e-5.
Signatures are cut into 16 chunks of 4 values. If two differ in at most 31 values, some chunk has at most
floor(31 / 16) = 1 of them, so they agree in 3 values of that chunk: with all 4 ways of leaving a value out, every pair
within the distance shares one of the 64 keys. Texts with equal sets are collapsed first. Pairs that share a key are
compared by signature inside a task, and only spanning stars leave it; the clusters so found hold every pair within the
distance. Inside a cluster links are then confirmed on the full shingle sets.

Buckets and clusters larger than a block are split into blocks, and one member, the pivot, is put into each of them. What
a block links with the pivot is one component and needs no more comparing among itself; only the loose rest meets all
other members, in pairs of blocks. So a group of N copies near one text costs N times a block, and one with L loose
members L times N more: no pair is left out.

Defined results: null text is an empty text; empty texts have no shingles and no links; rows with a null doc_id take no
part in links and get a null component_id and kept = true; rows that repeat a doc_id are one node with the texts of
both; of equal sets the smallest doc_id stands for all, so there are no ties; texts of any length are taken whole; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_skewed, materialized, stored, table
from .components import connected_components, local_stars
from .wordcodes import U, batch_words, mix, shingle_set, text_batches

VALUES, CHUNK = 64, 4
#: Places to which one row of a plan is sent at most; more places take more rows.
FAN = 1024
#: A key with more than two in so many of all entries is not dealt out by its value; entries of a run that is counted at once.
HOT, _RUN = 1000, 256_000
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**64, VALUES, dtype=U)[:, None]
_MUL = (_RNG.integers(0, 2**64, VALUES, dtype=U) | U(1))[:, None]


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    similarity_percent: int = 75
    max_distance: int = 31
    #: Members of a block; larger buckets and clusters are split into pairs of blocks.
    block: int = 256
    #: Shingles of a block of a cluster.
    block_shingles: int = 400_000
    #: Entries (two longs each) of a key that a task takes easily; keys with fewer are dealt out by their value.
    hot_entries: int = 100_000
    #: Rows (two longs each) up to which the clusters' membership is broadcast.
    broadcast_rows: int = 1_000_000


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 MinHash values of 16 bits."""
    low = np.full(VALUES, U(2**64 - 1))
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[None, i : i + 4096] ^ _XOR) * _MUL).min(axis=1))
    return (mix(low) >> U(48)).astype(np.uint16)


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, 64) keys of (n, 64) signatures: each chunk with each of its values left out."""
    parts = signatures.reshape(len(signatures), VALUES // CHUNK, CHUNK).astype(np.int64)
    keys = np.empty((len(signatures), VALUES // CHUNK, CHUNK), dtype=np.int64)
    for left_out in range(CHUNK):
        x, y, z = [parts[:, :, k] for k in range(CHUNK) if k != left_out]
        tag = np.arange(VALUES // CHUNK) * CHUNK + left_out
        keys[:, :, left_out] = (tag[None, :] << 48) | (x << 32) | (y << 16) | z
    return keys.reshape(len(signatures), VALUES)


def sketches(docs: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes, null for empty sets), signature (128 bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, hashes, signatures = [], [], []
            for _, _, data, starts in text_batches(frame["text"].tolist()):
                codes, _, _, first = batch_words(data, starts)
                for i in range(len(starts) - 1):
                    s = shingle_set(codes[first[i] : first[i + 1]], params.shingle)
                    sizes.append(len(s))
                    if len(s):
                        hashes.append(np.array([mix(s).sum(dtype=U), mix(s ^ _XOR[0]).sum(dtype=U)]).tobytes())
                        signatures.append(signature(s).tobytes())
                    else:
                        hashes.append(None)
                        signatures.append(None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_shingles": sizes, "set_hash": hashes, "signature": signatures})

    schema = "doc_id bigint, n_shingles bigint, set_hash binary, signature binary"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            new[0] = True
        at = np.flatnonzero(new)
        if len(at) == 0:
            held.append(batch)
            continue
        cut = int(at[-1])
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _pivots(t: pa.Table) -> np.ndarray:
    """Each row's pivot, or the row's own doc in groups that are not split."""
    return pc.coalesce(t.column("pivot"), t.column("doc")).to_numpy()


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = False
    for k in keys:
        c = _column(t, k)
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1


def _each(df: DataFrame, first: Column, n: Column, name: str) -> DataFrame:
    """A row for each of the n numbers from first on, in column name; in two steps, so no long array is made."""
    df = df.withColumn("_first", first.cast("int")).withColumn("_end", F.col("_first") + n.cast("int"))
    df = df.withColumn("_step", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1, F.lit(FAN))))
    return df.withColumn(name, F.explode(F.sequence(F.col("_step"), F.least(F.col("_end"), F.col("_step") + FAN) - 1))).drop("_first", "_end", "_step")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Columns bi = bj = own: each row's block (by hash of doc) of its group's blocks; the pivot goes to all of them."""
    split = F.col("blocks") > 1
    everywhere = split & (F.col("doc") == F.col("pivot"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks").cast("bigint"))
    df = _each(members, F.when(everywhere, F.lit(0)).otherwise(own), F.when(everywhere, F.col("blocks")).otherwise(F.lit(1)), "own")
    return df.withColumn("pivot", F.when(split, F.col("pivot"))).withColumn("bi", F.col("own")).withColumn("bj", F.col("own"))


def _loose_pairs(members: DataFrame) -> DataFrame:
    """Sends loose rows to their block's pairs with all blocks, the others to their block's pairs with the loose ones."""
    loose = F.pmod(F.xxhash64("doc", F.lit("loose")), F.col("loose_blocks").cast("bigint")).cast("int")
    other = F.col("loose_blocks") + F.pmod(F.xxhash64("doc"), F.col("blocks").cast("bigint")).cast("int")
    df = members.withColumn("own", F.when(F.col("loose"), loose).otherwise(other))
    met = F.when(F.col("loose"), F.col("loose_blocks") + F.col("blocks")).otherwise(F.col("loose_blocks"))
    df = _each(df, F.lit(0), met, "_j")
    return df.withColumn("bi", F.least("own", "_j")).withColumn("bj", F.greatest("own", "_j")).withColumn("pivot", F.lit(None).cast("bigint"))


def _spanned(members: DataFrame, weight: Column, payload: Callable[[DataFrame], DataFrame], compare: Callable, params: NearParams) -> DataFrame:
    """Edges (a, b) that span all links in the groups of members (grp, doc, blocks, pivot and what weight needs).

    payload adds to rows the column that compare needs; compare gives a, b of links, and doc, null, grp of loose members.
    """

    def compared(placed: DataFrame) -> DataFrame:
        rows = payload(placed.select("grp", "bi", "bj", "own", "pivot", "doc", *[c for c in placed.columns if c == "signature"]))
        return rows.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "own").mapInArrow(compare, "a bigint, b bigint, grp bigint")

    found = stored(compared(_in_blocks(members)), "links")
    edges, loose = found.filter("b is not null").select("a", "b"), found.filter("b is null").select("grp", F.col("a").alias("doc")).distinct()
    if loose.isEmpty():
        return edges
    loose = loose.withColumn("loose", F.lit(True))
    # of split groups only, one row each
    sizes = members.filter("blocks > 1").join(loose, ["grp", "doc"]).groupBy("grp").agg(weight.cast("int").alias("loose_blocks"))
    rest = members.filter("blocks > 1").join(broadcast_if_small(materialized(sizes), params.broadcast_rows), "grp")
    rest = rest.join(loose, ["grp", "doc"], "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
    return edges.unionByName(compared(_loose_pairs(rest)).filter("b is not null").select("a", "b"))


def _links_and_loose(a: np.ndarray, b: np.ndarray, grp: np.ndarray, doc: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
    """Stars of the links (a, b), and of rows in split groups those that the links do not join with their pivot."""
    node, root = local_stars(a, b)

    def label(x: np.ndarray) -> np.ndarray:
        if len(node) == 0:
            return x
        at = np.minimum(np.searchsorted(node, x), len(node) - 1)
        return np.where(node[at] == x, root[at], x)

    loose = np.flatnonzero(label(doc) != label(pivot))
    none = pa.nulls(len(loose), pa.int64())
    columns = [(pa.array(node, pa.int64()), pa.array(doc[loose], pa.int64())), (pa.array(root, pa.int64()), none), (pa.nulls(len(node), pa.int64()), pa.array(grp[loose], pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "grp"])


def hamming_stars(reps: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) whose components hold every pair of representatives within the signature distance."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
                doc = np.repeat(part.column("doc").to_numpy(), VALUES)
                yield pa.RecordBatch.from_arrays([pa.array(signature_keys(sig).ravel()), pa.array(doc)], names=["grp", "doc"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["grp", "bi", "bj"]):
            group, doc, own, bi, bj = _starts(t, ["grp", "bi", "bj"]), _column(t, "doc"), _column(t, "own"), _column(t, "bi"), _column(t, "bj")
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            rows = np.arange(len(doc))
            for k in range(1, len(doc)):
                rows = rows[: np.searchsorted(rows, len(doc) - k)]
                rows = rows[group[rows] == group[rows + k]]
                if len(rows) == 0:
                    break
                r = rows[(bi[rows] == bj[rows]) | (own[rows] != own[rows + k])]
                close = (sig[r] != sig[r + k]).sum(axis=1) <= params.max_distance
                left.append(doc[r[close]])
                right.append(doc[r[close] + k])
            yield _links_and_loose(np.concatenate(left), np.concatenate(right), _column(t, "grp"), doc, _pivots(t))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys that hold more than one in HOT entries of a run of texts, with their number there."""

        def out() -> Iterator[pa.RecordBatch]:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n * HOT >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(n[often])], names=["grp", "n"])

        held, size = [], 0
        for batch in keys(batches):
            held.append(batch.column("grp").to_numpy())
            size += batch.num_rows
            if size >= _RUN:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    sketched = reps.select("doc", "signature")
    entries = sketched.mapInArrow(keys, "grp bigint, doc bigint")
    # a key with two in HOT of all entries has one in HOT of them in the runs where it is frequent; at most HOT keys have that
    total = sketched.count() * VALUES
    hot = materialized(sketched.mapInArrow(frequent, "grp bigint, n bigint").groupBy("grp").agg(F.sum("n").alias("n")).filter((F.col("n") * HOT >= total) & (F.col("n") >= params.hot_entries)).select("grp"))
    blocks = F.ceil(F.count("*") / F.lit(params.block)).cast("int")
    sums = [F.count("*").alias("n"), blocks.alias("blocks"), F.min("doc").alias("pivot")]
    rest = entries
    if not hot.isEmpty():
        rest = entries.join(F.broadcast(hot), "grp", "left_anti")
    dealt = rest.repartition("grp")
    kept = dealt.join(dealt.groupBy("grp").agg(*sums).filter("n > 1"), "grp")
    if not hot.isEmpty():
        # entries of frequent keys stay where they are; each task sums its own before they meet
        of_hot = entries.join(F.broadcast(hot), "grp")
        kept = kept.unionByName(of_hot.join(F.broadcast(of_hot.groupBy("grp").agg(*sums).filter("n > 1")), "grp"))
    members = stored(kept.join(sketched, "doc").select("grp", "doc", "blocks", "pivot", "signature"), "members")
    return _spanned(members, blocks, lambda placed: placed, compare, params)


def _confirm(sets: list[np.ndarray], doc: np.ndarray, side: np.ndarray, one_block: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a group whose sets are that similar; between two blocks, links inside one are left to it."""
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    label, a, b = np.arange(len(sets)), [], []
    marked = np.zeros(len(values), dtype=bool)
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        others = others[(label[others] != label[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))]
        if not one_block:
            others = others[side[others] != side[i]]
        if len(others) == 0:
            continue
        marked[ids[offsets[i] : offsets[i + 1]]] = True
        lengths = sizes[others]
        begins = np.cumsum(lengths) - lengths
        picked = np.arange(lengths.sum()) - np.repeat(begins - offsets[others], lengths)
        common = np.add.reduceat(marked[ids[picked]].astype(np.int64), begins)
        marked[ids[offsets[i] : offsets[i + 1]]] = False
        for j in others[100 * common >= percent * (lengths + sizes[i] - common)]:
            if label[j] != label[i]:
                a.append(doc[i])
                b.append(doc[j])
                label[label == label[j]] = label[i]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def confirmed_links(docs: DataFrame, clusters: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) that span the links inside clusters (doc, cluster, n_shingles), tested on full sets."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = batch.column("text").to_pylist(), []
            for _, _, data, starts in text_batches(texts):
                codes, _, _, first = batch_words(data, starts)
                sets += [shingle_set(codes[first[i] : first[i + 1]], params.shingle).tobytes() for i in range(len(starts) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sets, pa.binary()), batch.column("places")], names=["doc", "shingles", "places"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["grp", "bi", "bj"]):
            group, doc, own, bi, bj = _starts(t, ["grp", "bi", "bj"]), _column(t, "doc"), _column(t, "own"), _column(t, "bi"), _column(t, "bj")
            sets = [np.frombuffer(x, dtype=U) for x in t.column("shingles").to_pylist()]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(doc)]])
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x > 1:
                    a, b = _confirm(sets[x:y], doc[x:y], own[x:y], bi[x] == bj[x], params.similarity_percent)
                    left.append(a)
                    right.append(b)
            yield _links_and_loose(np.concatenate(left), np.concatenate(right), _column(t, "grp"), doc, _pivots(t))

    def blocks(of: str) -> Column:
        return F.greatest(F.ceil(F.count("*") / F.lit(params.block)), F.ceil(F.sum(of) / F.lit(params.block_shingles))).cast("int")

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))

    def with_sets(placed: DataFrame) -> DataFrame:
        # a text is cut into shingles once for all of its places, or for each FAN of them
        places = placed.groupBy("doc", F.floor((F.col("bi") + F.col("bj")) / F.lit(FAN)).alias("part")).agg(F.collect_list(F.struct("grp", "bi", "bj", "own", "pivot")).alias("places"))
        own = texts.join(broadcast_if_small(places, params.broadcast_rows), "doc")
        kind = "array<struct<grp:bigint,bi:int,bj:int,own:int,pivot:bigint>>"
        sets = own.select("doc", "text", "places").mapInArrow(to_sets, f"doc bigint, shingles binary, places {kind}")
        return sets.select("doc", "shingles", F.inline("places")).select("grp", "bi", "bj", "own", "pivot", "doc", "shingles")

    # a pivot by hash, so that it is a member like any other
    size = clusters.groupBy("cluster").agg(blocks("n_shingles").alias("blocks"), F.min_by("doc", F.xxhash64("doc")).alias("pivot"))
    members = materialized(clusters.join(size, "cluster").select(F.col("cluster").alias("grp"), "doc", "blocks", "pivot", "n_shingles"))
    return _spanned(members, blocks("n_shingles"), with_sets, confirm, params)


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    sketch = materialized(sketches(docs, params))
    full = sketch.filter("set_hash is not null and doc_id is not null")
    classes = full.groupBy("set_hash").agg(
        F.min("doc_id").alias("doc"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    )
    reps = materialized(classes)
    clusters = connected_components(hamming_stars(reps, params)).select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    sized = clusters.join(reps.groupBy("doc").agg(F.max("n_shingles").alias("n_shingles")), "doc")
    near = confirmed_links(docs, sized, params).select("a", "b")
    # equal sets: a copy is linked with its class; only classes of several ids need it
    several = reps.filter("last > doc").select("set_hash", "doc", "n")
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = join_skewed(full.select("set_hash", "doc_id"), several, "set_hash", "n", total).filter("doc_id > doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    found = connected_components(near.unionByName(copies))
    out = sketch.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
