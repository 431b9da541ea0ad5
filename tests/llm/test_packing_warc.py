import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from codelode.llm import bpe, packing, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
STRANGE = [
    "", None, "don't I'LL we've 'S x''d '", "<|endoftext|> a<|startoftext|>b <b>", "naïve ÀÉß ÿ µ ª º ×÷", "日本語 テスト", "a b c", "é Å İI ſK",
    "x" * 500, "12345 3.14 a1b2", "__x__ $%^&*( `~", "😀😀", "a\x1cb \x85c", "Σας ΣΑΣ", "…—’ It’s", "aaaaaa ababab",
]


def test_ids_equal_the_library():
    words = bpe.load(PATH)
    rng = np.random.default_rng(3)
    texts = STRANGE + ["".join(rng.choice(list("abcdefgh'.,!?-_0123ABC éüß<>\n\t"), 200)) for _ in range(200)]
    assert [x.tolist() for x in words.encode(texts)] == [words.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_pack(df, docs):
    rows = packing.pack(df).toPandas()
    library = bpe.load(PATH).library
    want = {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.setdefault(i, []).append(ids)
    assert rows.length.sum() == sum(len(x) for xs in want.values() for x in xs)
    for i, own in rows[rows.doc_id.notna()].groupby("doc_id"):
        copies = want[i]
        seen = sorted((r.start, r.length, r.ids_crc32) for r in own.itertuples())
        assert all(zlib.crc32(copies[0][a : a + n].tobytes()) == c for a, n, c in seen)
        assert sum(n for _, n, _ in seen) == len(copies[0]) * len(copies)
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    sizes = rows.groupby("sequence_id").length.sum()
    assert all(n <= 2048 and (n & (n - 1)) == 0 for n in sizes)


def test_packing_is_whole_and_without_padding(spark, small):
    check_pack(small, [(r["doc_id"], r["text"]) for r in small.collect()])


def test_packing_of_odd_documents(spark, odd, empty):
    check_pack(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty).count() == 0


def test_least_squares_lowers_the_residual():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 50, 2048)
    h[0] = 0
    columns = packing.enumerate_combinations(h, 2048, 4)
    assert columns and all(sum(n * t for n, t in c) == 2048 for c in columns)
    x = packing.non_negative_least_squares(h, columns, 12)
    rest = h.astype(float)
    for c, v in zip(columns, x):
        for n, t in c:
            rest[n] -= t * v
    assert (x >= 0).all() and (rest**2).sum() < 0.5 * (h.astype(float) ** 2).sum()


def items(data):
    return [(x.get("page_id"), x.get("gap")) for x in warc.SalvageReader(io.BytesIO(data), len(data)).items()]


@pytest.fixture(scope="module")
def members():
    return [warc.member(warc.record_bytes(i, f"http://a/{i}", b"<p>%d</p>" % i * 50, None, False, "d"), 4) for i in range(6)]


def test_salvage_of_compressed_archives(members):
    whole = b"".join(members)
    assert items(whole) == [(i, None) for i in range(6)]
    bad = bytearray(whole)
    bad[len(members[0]) + 40] ^= 255
    got = items(bytes(bad))
    assert [p for p, _ in got] == [0, None, 2, 3, 4, 5] and got[1][1]
    assert [p for p, _ in items(whole[5:])] == [None, 1, 2, 3, 4, 5]
    assert [p for p, _ in items(whole[:-7])] == [0, 1, 2, 3, 4, None]
    assert [p for p, _ in items(members[0] + b"junk" * 10 + members[1])] == [0, None, 1]
    assert items(b"garbage") == [(None, "no version line")] and items(b"") == []
    gaps = [x for x in warc.SalvageReader(io.BytesIO(bytes(bad)), len(bad)).items() if x.get("gap")]
    assert (gaps[0]["start"], gaps[0]["end"]) == (len(members[0]), len(members[0]) + len(members[1]))


def test_salvage_of_plain_archives():
    records = [warc.record_bytes(i, "u", b"z" * (i * 40_000 + 3), None, False, "d") for i in range(4)]
    whole = b"".join(records)
    assert items(whole) == [(i, None) for i in range(4)]
    for at in (3, 900):
        bad = bytearray(whole)
        bad[len(records[0]) + at] ^= 255
        assert [p for p, _ in items(bytes(bad))] == [0, None, 2, 3]


def round_trip(spark, pages, folder, params=warc.WarcParams()):
    found = warc.read_archives(warc.write_archives(pages, folder, params), folder).filter("gap is null")
    return [r.asDict() for r in found.collect()]


def test_round_trip(spark, tmp_path):
    html = [(1, "u", "<p>é</p>"), (2, None, None), (3, "u\r\nx", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (7, "u", "z" * 300_000)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    rows = round_trip(spark, pages, f"file://{tmp_path}/w")
    assert len(rows) == len(html)
    first = {"<p>é</p>": 1, "": 2, "z" * 300_000: 7}
    for r in rows:
        text = next(h or "" for i, _, h in html if i == r["page_id"])
        raw = text.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = r["page_id"] != first[text]
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (first[text] if again else None)
        assert r["payload"] == (None if again else raw)
    assert {r["record_type"] for r in round_trip(spark, pages, f"file://{tmp_path}/v", warc.WarcParams(min_bytes=10**6))} == {"response"}
    assert round_trip(spark, pages.limit(0), f"file://{tmp_path}/e") == []


def test_pipeline_stages_keep_columns_and_decide(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, d), f"test-{name}")
        assert docs.columns == columns
        left.append(docs.count())
    assert left[0] > left[1] > left[2] > left[3] == left[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == left[-1]


def test_pipeline_of_odd_documents(spark, odd, empty):
    for frame in (odd, empty):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.count()


def test_stages_keep_extra_columns(spark, clashing):
    from pyspark.sql import functions as F

    docs = clashing.withColumns({"entities": F.lit("mine"), "row": F.lit(1), "kept": F.lit("k"), "plain": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert {r["entities"] for r in docs.collect()} == {"mine"} and docs.count() == 4
    assert corpus_pipeline.STAGES[0][1](spark, docs, "").columns == docs.columns


def test_round_trip_query_equals_its_sql(spark):
    import duckdb

    from codelode.llm import warc

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    got = warc.op5_warc_round_trip(spark, data)
    cols = sorted(got.columns)
    want = con.sql(warc.OP5_SQL).select(", ".join(cols)).fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want))


def test_a_payload_that_many_repeat(spark, tmp_path):
    """Beyond the broadcast's bound the commonest payloads stay where they are; the records are the same, and names do not clash."""
    rows = [(i, f"u{i}", "error page" if i % 2 else f"page {i // 6}", 1, "s", b"") for i in range(600)] + [(None, "x", "error page", 1, "s", b""), (7, "again", "error page", 1, "s", b"")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long, sha string, payload binary").repartition(6)
    found = []
    for k, params in enumerate((warc.WarcParams(), warc.WarcParams(broadcast_rows=1, archive_bytes=2000))):
        folder = f"file://{tmp_path}/{k}"
        manifest = warc.write_archives(pages, folder, params)
        read = warc.read_archives(manifest, folder, params=params)
        assert read.rdd.getNumPartitions() <= max(1, min(manifest.count(), spark.sparkContext.defaultParallelism))
        found.append(sorted(map(tuple, read.select("page_id", "record_type", "refers_to", "payload_digest").collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 602
    assert sum(r[1] == "revisit" and r[2] == 1 for r in found[0]) == 301
