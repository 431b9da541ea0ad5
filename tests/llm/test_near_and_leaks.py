import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import decontamination, near_duplicates, substring_dedup
from codelode.llm.wordcodes import batch_words, shingle_set, text_batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def compare(df, texts):
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(df).collect()}
    want, sizes = brute_components(texts)
    assert {i: got[i]["component_id"] for i in texts} == want
    assert {i: got[i]["n_shingles"] for i in texts} == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in texts)


def test_equals_brute_force_on_documents(spark, small):
    compare(small, {r["doc_id"]: r["text"] for r in small.collect()})


def test_equals_brute_force_on_a_chain_of_edits(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"w{rng.randrange(1000)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    small_blocks = near_duplicates.NearParams(block=16)  # the way of large groups: pairs of blocks
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, small_blocks).collect()}
    assert got == brute_components(texts)[0]


def test_large_groups_of_any_ids_equal_brute_force(spark):
    """Three families of edits and loose texts between them, ids below zero, groups of many blocks."""
    rng = random.Random(6)
    families, texts = [[f"{f}{rng.randrange(400)}" for _ in range(100)] for f in "xyz"], {}
    for i in range(240):
        words = list(families[i % 3] if i % 8 else families[0][:50] + families[1][50:])
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(100)] = f"w{rng.randrange(900)}"
        texts[i - 120] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_components(texts)[0]
    for params in (near_duplicates.NearParams(block=12), near_duplicates.NearParams(block_shingles=900), near_duplicates.NearParams(block=12, broadcast_rows=0)):
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, params).collect()} == want


def test_places_in_blocks_grow_with_the_group(spark):
    n, blocks = 5000, 2500
    members = spark.range(n).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("doc"), F.lit(blocks).alias("blocks"), F.lit(7).cast("long").alias("pivot"))
    placed = near_duplicates._in_blocks(members)
    assert placed.count() == n + blocks - 1 and placed.filter("doc = 7").select("bi").distinct().count() == blocks
    loose = members.withColumn("loose", F.col("doc") < 10).withColumn("loose_blocks", F.lit(2))
    assert near_duplicates._loose_pairs(loose).count() == 10 * (blocks + 2) + (n - 10) * 2


def test_keys_find_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, 64, dtype=np.uint16)
    for _ in range(200):
        b = a.copy()
        b[rng.choice(64, 31, replace=False)] ^= 1
        keys = near_duplicates.signature_keys(np.stack([a, b]))
        assert len(set(keys[0]) & set(keys[1])) > 0


def test_odd_near_duplicates(spark, odd, empty, clashing):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[None]["component_id"] is None and by[None]["kept"]
    assert by[6]["n_shingles"] == 1
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert near_duplicates.near_duplicates(clashing).count() == 4


def test_word_codes_equal_only_for_equal_words():
    texts = ["Ab cD  ab\tCd", "", None, "é ab"]
    ((_, _, data, starts),) = text_batches(texts)
    codes, _, _, first = batch_words(data, starts)
    assert codes[0] == codes[2] == codes[5] and codes[1] == codes[3] and first.tolist() == [0, 4, 4, 4, 6]
    assert len(shingle_set(codes[:4])) == 1 and len(shingle_set(codes[:0])) == 0


def reference_score(item, window):
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recursion():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64)) for _ in range(60)]
    score, _ = decontamination.align([a for a, _ in pairs], [b for _, b in pairs])
    assert score.tolist() == [reference_score(a.tolist(), b.tolist()) for a, b in pairs]


def test_leaks_found_and_clean_left(spark, small):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(small, benchmark).collect()}
    exact = {(r["doc_id"], i) for r in small.collect() for i, t in items.items() if t in (r["text"] or "")}
    assert exact <= got
    words = items[0].split()
    edited = " ".join(w if k % 8 else "changed" for k, w in enumerate(words))
    pasted = spark.createDataFrame([(1, f"before it {edited} after it"), (2, "nothing of that kind is in this text at all")], "doc_id long, text string")
    found = decontamination.leaks(pasted, benchmark).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 0)] and 0.55 <= found[0]["score"] < 1


def test_edited_copies_equal_brute_force_alignment(spark):
    rng = random.Random(7)
    item = [f"q{k}" for k in range(60)]
    edited = {n: [w if k % n else f"x{n}y{k}" for k, w in enumerate(item, 1)] for n in (3, 4, 5, 6)}
    texts = {n: [f"f{rng.randrange(500)}" for _ in range(80)] + words + [f"f{rng.randrange(500)}" for _ in range(80)] for n, words in edited.items()}
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    want = {n: reference_score(item, t) / 120 for n, t in texts.items()}
    want = {n: v for n, v in want.items() if v >= 0.55}
    assert sorted(want) == [4, 5, 6]
    for exact in ({}, {9: item}):  # alone, and beside an exact copy
        docs = spark.createDataFrame([(n, " ".join(t)) for n, t in {**texts, **exact}.items()], "doc_id long, text string")
        got = {r["doc_id"]: r["score"] for r in decontamination.leaks(docs, benchmark).collect()}
        assert got == pytest.approx({**want, **{n: 1.0 for n in exact}})


def test_recall_against_alignment_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 6000")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    params = decontamination.LeakParams()
    index = decontamination.ItemIndex([tuple(r) for r in benchmark.select("item_id", "text").collect()], params.seed_words)
    texts = decontamination.ItemIndex([tuple(r) for r in docs.select("doc_id", "text").collect()], params.seed_words)
    want = set()
    for i, item in zip(index.ids, index.codes):
        own = set(item.tolist())
        # a text that shares fewer words with an item than its score needs cannot reach it
        near = [k for k, c in enumerate(texts.codes) if len(item) and sum(w in own for w in c.tolist()) >= params.min_score * len(item)]
        for at in range(0, len(near), 64):
            part = near[at : at + 64]
            score, _ = decontamination.align([item] * len(part), [texts.codes[k] for k in part])
            want |= {(texts.ids[k], i) for k, s in zip(part, score) if s >= params.min_score * 2 * len(item)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}
    assert got <= want and len(want) > 10 and len(got) >= 0.95 * len(want)


def test_extra_columns_of_any_name_here(spark, clashing):
    docs = clashing.withColumns({"item_id": F.lit(1), "start": F.lit(0), "digest": F.lit("d"), "rank": F.lit(0.0), "_id": F.lit(5), "row": F.lit(2), "id": F.lit(3), "n": F.lit(1)})
    items = spark.createDataFrame([(1, "this is text number 2 of a small set with words enough")], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.leaks(docs, items).collect()} >= {2}
    out = substring_dedup.without_duplicates(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10)))
    assert out.columns == [*docs.columns, "removed"] and out.filter("doc_id >= 10").filter("trim(text) <> ''").count() == 0


def test_a_benchmark_beyond_a_block_reads_documents_once(spark, small):
    """Ten blocks' worth of items, short ones among them: the same rows, and every document goes to Python once."""
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    benchmark = benchmark.unionByName(spark.createDataFrame([(900, "zebra"), (901, "Nothing? Nothing!"), (902, ""), (None, "one two three four five six")], "item_id long, text string"))
    more = spark.createDataFrame([(5000, "a zebra, and one more zebra; one two three four five six"), (5000, "nothing nothing"), (None, "Zebra."), (5001, None), (5002, "")], "doc_id long, text string")
    docs = small.select("doc_id", "text").unionByName(more)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = docs.mapInArrow(counted, docs.schema)
    many = decontamination.leaks(seen, benchmark, decontamination.LeakParams(block_chars=1000))
    got = sorted(map(tuple, many.collect()), key=repr)
    assert read.value == docs.count()
    assert got == sorted(map(tuple, decontamination.leaks(docs, benchmark).collect()), key=repr) and len(got) > 6


def test_seeds_are_the_rarest_that_occur():
    rng = np.random.default_rng(4)
    n_items, n = 40, 600
    item, counts = np.sort(rng.integers(0, n_items, n)), rng.integers(0, 5, n)
    gram = rng.integers(0, 1 << 60, n).astype(np.uint64)
    places = np.bincount(item, minlength=n_items) + rng.integers(0, 4, n_items)
    keep = decontamination.rarest(item, gram, counts, places, 0.6)
    for i in range(n_items):
        own = np.flatnonzero(item == i)
        there = [k for k in own if counts[k] > 0]
        kept, left = counts[[k for k in own if keep[k]]], counts[[k for k in there if not keep[k]]]
        assert not keep[[k for k in own if counts[k] == 0]].any()
        assert len(kept) == min(len(there), int(np.ceil(places[i] * 0.6)))
        assert not len(kept) or not len(left) or kept.max() <= left.min()


def test_common_phrases_are_no_seeds(spark):
    """What many texts share is left out while an item has rarer sequences, and an edited copy is found all the same."""
    own = [f"w{k}" for k in range(20)]
    item = "which of the following is true about the " + " ".join(own)
    docs = [(k, f"which of the following is true about the thing{k}") for k in range(50)] + [(99, "x " + " ".join(w if k % 7 else "y" for k, w in enumerate(own)) + " which of")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontamination.ItemIndex([(1, item)], 3)
    index.keep_rare(decontamination._counted(df, index, 3), 0.4)
    assert len(index.gram) > 5 and index.place.min() > 5
    assert [r["doc_id"] for r in decontamination.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string"), decontamination.LeakParams(min_score=0.4, rare_share=0.4)).collect()] == [99]


def test_odd_leaks(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "ten one"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(odd, items).collect()}
    assert {(4, 3), (4, 4)} <= got and not {1, 2} & {i for _, i in got}
    assert decontamination.leaks(empty, items).count() == 0 and decontamination.leaks(odd, items.limit(0)).count() == 0


def test_units_keep_the_first_and_their_offsets(spark, odd, empty):
    line = "this line has more than six words in it"
    texts = {1: f"Own start of one. {line}\nx", 2: f"{line}! Other things follow here without any copy", 3: f"  {line.upper()}  "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(substring_dedup.duplicate_units(df).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["kept_doc_id"]) for r in got] == [(2, 1), (3, 1)]
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["end"]].strip("!").lower() == line
        assert texts[1][r["kept_start"] : r["kept_end"]] == line
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_duplicates(df).collect()}
    assert left[1] == texts[1] and line not in left[2] and left[3].strip() == ""
    assert substring_dedup.duplicate_units(empty).count() == 0
    assert substring_dedup.duplicate_units(odd).count() >= 0


def test_units_equal_brute_force(spark, small):
    seen, want = {}, set()
    for r in sorted(small.collect(), key=lambda r: r["doc_id"]):
        for a, b, _, digest in substring_dedup.units_of(r["text"] or "", 6):
            if digest in seen:
                want.add((r["doc_id"], a, b, *seen[digest]))
            else:
                seen[digest] = (r["doc_id"], a, b)
    got = {(r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"], r["kept_end"]) for r in substring_dedup.duplicate_units(small).collect()}
    assert got == want


def test_repeated_lines_go_whole(spark):
    short = "Come in. Sit down. No, stay there. It is late. Who said so? Nobody did."
    mixed = "This sentence alone is long enough to count here. It is. So is this one, which has words enough as well. Yes!"
    chinese = "这是一个没有空格的长段落" * 5
    verse = "red sky\nat night\nblue sea\nby day"
    own = [f"Own line {x} stands here and has no copy anywhere." for x in ("one", "two")]
    texts = {1: f"{own[0]}\n{short}\n{mixed}\n\n{chinese}\n\n{verse}", 2: f"{mixed.upper()}\n{own[1]}\n  {short}\n\n{verse}\n\n{chinese}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {(r["start"], r["end"]): (r["kept_doc_id"], r["kept_start"], r["kept_end"]) for r in substring_dedup.duplicate_units(df).collect()}
    for passage in (short, mixed.upper(), chinese, verse):
        a = texts[2].index(passage)
        kept = spans[a, a + len(passage)]
        assert kept[0] == 1 and texts[1][kept[1] : kept[2]].lower() == passage.lower()
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_duplicates(df).collect()}
    assert left[1] == texts[1] and left[2].split("\n") == ["", own[1], "  ", "", "", "", ""]
    # one text alone has nothing to lose, whatever its edges
    alone = spark.createDataFrame([(1, "- one two three four five six seven. -\n\n(eight nine ten eleven twelve thirteen.)")], "doc_id long, text string")
    assert substring_dedup.duplicate_units(alone).count() == 0


def test_one_chunk_key_in_most_sets(spark):
    """A key that 20,000 unlike texts share stays where its entries are: no task gets them all before blocks are made."""
    import numpy as np
    from codelode.llm.near_duplicates import NearParams, VALUES, hamming_stars

    n = 20_000
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (n, VALUES), dtype=np.uint16)
    sig[:, :3] = 7
    sig[n - 1] = sig[0]
    sig[n - 1, 10:30] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "doc long, signature binary").repartition(8)
        found = hamming_stars(reps, NearParams(block=2048, hot_entries=1000)).filter("a is not null and b is not null").select("a", "b").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(min(r), max(r)) for r in map(tuple, found)} == {(0, n - 1)}
