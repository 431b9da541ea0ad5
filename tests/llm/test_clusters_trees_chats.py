import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from codelode.llm import centroids, chat, merkle
from hypothesis import given, settings
from hypothesis import strategies as st

VECTORS = "vec_id long, embedding array<double>, centroid_sha256 int"


def clustered(vectors, params):
    """Lloyd's rounds over (id, components) in Python integers."""
    rows = [(i, [int(v) * params.scale if abs(v) > 2**52 else math.floor(v * params.scale) for v in x]) for i, x in vectors]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{params.seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [r[1] for r in first[: params.centroids]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))
    for _ in range(params.rounds):
        groups = {}
        for _, x in rows:
            groups.setdefault(near(x)[1], []).append(x)
        centers = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, near(x)[1], near(x)[0]) for i, x in rows]
    fits = lambda v: v if v < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    total = sum(d for _, _, d in found)
    return sorted(((i, j, fits(d), fits(sum(e for _, k, e in found if k == j)), fits(total), digest(centers[j])) for i, j, d in found), key=repr)


@pytest.mark.parametrize("reach", [1.0, 3e4, 2e5, 1e8, 1e17, 1e60])
def test_clusters_equal_integer_rounds(spark, reach):
    """Within the bound of exact products, beyond it, beyond 64 bits, and all in one table."""
    rng = random.Random(reach)
    params = centroids.ClusterParams(dimensions=5, centroids=4, rounds=3)
    vectors = [(i % 70, [rng.uniform(-1, 1) * (reach if i % 3 else 1.0) for _ in range(5)]) for i in range(90)]
    vectors += [(None, vectors[0][1]), vectors[5], (200, [0.5] * 5), (201, [-0.5 / 64] * 5)]
    df = spark.createDataFrame([(i, x, 0) for i, x in vectors], VECTORS).repartition(3)
    got = sorted(map(tuple, centroids.cluster(df, params).collect()), key=repr)
    assert got == clustered(vectors, params)


def test_products_are_exact_up_to_their_bound():
    d = 64
    limit = centroids._limit(53, d)
    assert d * (2 * limit) ** 2 < 2**53 <= d * (2 * limit + 2) ** 2
    rng = np.random.default_rng(5)
    x = rng.integers(-limit, limit + 1, (200, d))
    x[0], x[1], x[2] = limit, -limit, x[3]
    c = [*rng.integers(-limit, limit + 1, (7, d)).tolist(), x[3].tolist(), x[3].tolist(), [-limit] * d]
    number, distance = centroids.nearest(x, c)
    for row, j, e in zip(x.tolist(), number.tolist(), distance.tolist()):
        assert (e, j) == min((sum((a - b) ** 2 for a, b in zip(row, y)), k) for k, y in enumerate(c))


def test_odd_vectors(spark):
    p = centroids.ClusterParams()
    nothing = spark.createDataFrame([(1, None, 1), (2, [1.0], 1), (3, [float("nan")] * 64, 1), (4, [None] * 64, 1), (5, [], 1)], VECTORS)
    assert centroids.cluster(nothing, p).collect() == [] and centroids.cluster(nothing.limit(0), p).collect() == []
    same = spark.createDataFrame([(7, [0.25] * 64, 1)] * 40, VECTORS)
    rows = centroids.cluster(same, p).collect()
    assert len(rows) == 40 and {(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in rows} == {(7, 0, 0, 0)}


def h(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def tree(digests):
    """Root and each leaf's runs (position, run) on the way up."""
    ways, level, at = [[] for _ in digests], digests, list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            ways[k].append((i % 16, runs[i // 16]))
        at = [i // 16 for i in at]
        level = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    return level[0], ways


def manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, h(*r))) for s in sources]
    trees = [tree([h(*r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, ways), upper in zip(groups, trees, above):
        for r, way in zip(g, ways):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad and r[4] is not None else r[4]
            folded = h(*r[:4], lower)
            siblings = []
            for k, run in way + upper:
                siblings += run[:k] + run[k + 1 :]
                folded = hashlib.sha256("".join(run[:k] + [folded] + run[k + 1 :]).encode()).hexdigest()
            out.append((r[0], h(*r), subroot, root, hashlib.sha256("".join(siblings).encode()).hexdigest(), folded, folded == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, path int, grp int"


def documents(sizes, rng):
    out = []
    for s, n in sizes.items():
        out += [(rng.choice([None, i, i, i, -i]), s, rng.choice([None, "en", "é"]), rng.choice([None, i]), rng.choice([None, "", "Text A", "ÄB é 😀", f"T{i}"])) for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1}, {"a": 16}, {"a": 17}, {"a": 2, "b": 1}, {None: 257, "": 16, "a": 1, "Z": 300, "é": 33, "z😀": 15}, {f"s{i}": 1 + i % 3 for i in range(300)}], ids=str)
def test_manifest_equals_recursion(spark, tmp_path, sizes):
    rows = documents(sizes, random.Random(len(sizes)))
    rows += rows[:3]
    spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == manifest(rows)


def test_manifest_of_one_source_over_many_tasks(spark, tmp_path):
    """Order by range parts one source, and even one repeated row; the frontier is shuffled in more than one round."""
    rows = [(i, "hot", "en", 1, f"Text {i}") for i in range(5000)] + [(9, "hot", "en", 1, "again")] * 700 + [(i, "s", None, 1, "X") for i in range(20)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS).repartition(5)
        placed = merkle.placed(merkle.leaves(docs)).collect()
        assert sorted((r["grp"], r["i"]) for r in placed) == [(0, i) for i in range(5700)] + [(1, i) for i in range(20)]
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        got = sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == manifest(rows)
    tampered = [r for r in got if not r[6]]
    assert tampered and all(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in tampered)


def test_tree_events_need_no_aligned_tasks():
    """Children may come in any order and from anywhere; a parent speaks once, when all are there."""
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    events = [merkle._event(1, 0, 300, 0, i, d) for i, d in enumerate(leaves)]
    rng = random.Random(3)
    links, frontier = [], events
    while frontier:
        rng.shuffle(frontier)
        parts = [frontier[i::3] for i in range(3)] if len(frontier) > 3 else [frontier]
        rows = [row for part in parts for row in merkle._resolved(1)(iter(part))]
        links += [r for r in rows if r[0]]
        frontier = [((g, n, level, parent), dict(zip(places, ds))) for done, g, n, level, parent, places, ds in rows if not done]
    top = max(links, key=lambda r: r[3])
    assert len({r[1:5] for r in links}) == len(links) == 19 + 2 + 1
    assert merkle.digest(top[6]) == tree(leaves)[0]


def test_empty_manifest(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, str(tmp_path)).collect() == []


PIECES = ["<", "[", "\\", "|turn|>", "/s>", "<|turn|>", "<|text|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<\\|end|>", " ", "\n", "é", "😀", "a b", "日本", " ", "\x00", "  x", "'s", "1"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
TEMPLATE = chat.ChatTemplate()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|end|>", "\\"]), TEXTS), min_size=1, max_size=5))
def test_formatting_is_reversible_and_masks_are_exact(turns):
    text, spans = chat.rendered(turns, TEMPLATE)
    assert chat.read_turns(text, TEMPLATE) == turns
    got = chat._tokenizer(TEMPLATE).encode(text, add_special_tokens=False)
    starts, ends = (np.array(v) for v in zip(*got.offsets))
    mask = chat.masked(spans, starts, ends)
    assert mask.tolist() == [int(any(a < e and s < b for a, b in spans.tolist())) for s, e in zip(starts.tolist(), ends.tolist())]
    assert chat.read_loss(text, mask, starts, ends, TEMPLATE) == [t for r, t in turns if r == "assistant" and t]


def test_pieces_have_the_tokens_of_the_whole(spark):
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choices(PIECES, k=30))) for c in range(30) for t in range(1 + c % 7)]
    turns += [(100, t, "assistant", "".join(rng.choices(PIECES, k=20))) for t in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    small = chat.ChatTemplate(segment_chars=300)
    parts = {}
    for i, r in enumerate(chat.formatted(df, small).collect()):
        parts.setdefault(r["conv_id"], []).append((i, r))
    assert len(parts[100]) > 20 and sum(len(v) for v in parts.values()) > len(parts) + 20
    for conv, rows in parts.items():
        own = [(r, x) for c, t, r, x in sorted(turns) if c == conv]
        text, spans = chat.rendered(own, TEMPLATE)
        got = chat._tokenizer(TEMPLATE).encode(text, add_special_tokens=False)
        mask = chat.masked(spans, *(np.array(v) for v in zip(*got.offsets)))
        assert "".join(r["formatted"] for _, r in rows) == text
        assert [x for _, r in rows for x in r["input_ids"]] == got.ids
        assert [x for _, r in rows for x in r["loss_mask"]] == mask.tolist()
    wide, narrow = ({tuple(r) for r in chat.digests(chat.formatted(df, t), t).collect()} for t in (TEMPLATE, small))
    assert wide == narrow and len(wide) == 31


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, task int"
    assert chat.formatted(spark.createDataFrame([], schema)).collect() == []
    assert chat.digests(chat.formatted(spark.createDataFrame([], schema))).collect() == []
    rows = chat.digests(chat.formatted(spark.createDataFrame([(None, None, None, None, 1), (1, 0, "assistant", None, 2)], schema))).collect()
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows} == {(None, 1, 0), (1, 1, 0)}
    with pytest.raises(ValueError):
        chat.ChatTemplate(end="<|a<|")
    with pytest.raises(ValueError):
        chat.rendered([], chat.ChatTemplate(text="<|turn|>"))
    with pytest.raises(ValueError):
        chat._tokenizer(chat.ChatTemplate(reserved=("</s>",)))
