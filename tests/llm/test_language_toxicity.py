import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import language_id, toxicity
from codelode.llm.char_grams import KneserNey, U, distinct, gram_runs

DATA = "/root/testdata/sf0.01"


def grams_of(texts):
    codes = []
    for _, c, start, end in gram_runs(texts):
        codes += [c[a:b] for a, b in zip(start, end)]
    return codes


def test_codes_depend_on_the_text_alone():
    together = grams_of(["abc déf", "x", None, "", "abc déf"])
    assert np.array_equal(together[0], grams_of(["abc déf"])[0])
    assert np.array_equal(together[0], together[4])
    assert len(together[2]) == len(together[3]) == 0


def test_probabilities_sum_to_one():
    codes, counts = distinct(np.concatenate(grams_of(["the cat sat on the mat and the rat ran"])))
    chars = np.unique(codes & U(0xFFFF))
    model = KneserNey(codes, counts, len(chars))
    for context in np.unique(codes >> U(16))[:10]:
        assert abs(model.probability((context << U(16)) | chars).sum() - 1) < 1e-9


def test_held_out_languages(spark):
    out = language_id.op1_language_id(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id")
    assert len(out) == len(docs)
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(out.doc_id, out.held_out))
    held = out[out.held_out]
    assert (docs.lang[held.doc_id].to_numpy() == held.lang_pred.to_numpy()).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_odd_languages(spark, odd, empty, small):
    models = language_id.fit(small)
    rows = {r["doc_id"]: r for r in language_id.predict(odd, models).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and rows[1]["score"] == 0
    assert rows[6]["lang_pred"] in models.languages
    assert language_id.predict(empty, models).count() == 0
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}


def test_held_out_toxicity(spark):
    out = toxicity.op8_toxicity(spark, DATA).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    held = out[out.held_out].join(labels, how="inner")
    right = (held.predicted == held.toxic).mean()
    assert right > 0.95 and out.score.between(0, 1).all()


def test_odd_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(odd, labels)
    assert toxicity.score_texts(odd, models).count() == odd.count()
    assert toxicity.fit(empty, labels) is None
    assert {r["score"] for r in toxicity.score_texts(odd, None).collect()} == {0.5}


def test_the_language_model_has_all_grams(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 3000, 50_000))) for _ in range(10)]
    rows = spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string")
    (model,) = language_id.fit(rows).models
    codes, counts = distinct(np.concatenate(grams_of(texts)))
    assert len(codes) > 400_000
    full = KneserNey(codes, counts, model.alphabet)
    assert np.array_equal(model.levels[0].codes, codes) and np.array_equal(model.levels[0].counts, counts)
    assert [x.discount for x in model.levels] == [x.discount for x in full.levels]


def test_rejection_limits_come_from_all_training_rows(spark):
    rows = spark.range(25_000).selectExpr("id doc_id", "concat('word ', repeat(char(97 + id % 26), 1 + cast(id % 17 as int))) text", "'en' lang")
    models = language_id.calibrate(language_id.fit(rows), rows)
    bits = models.entropies([r["text"] for r in rows.collect()])[0][:, 0]
    assert abs(models.limits[0] - (bits.mean() + 5 * max(bits.std(ddof=1), 0.05))) < 1e-9


def test_the_toxicity_model_has_all_grams(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 20_000, 600_000)))) for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    learned = docs.filter("pmod(xxhash64(doc_id, 'fold'), 4) <> 0")
    codes, _ = distinct(np.concatenate(grams_of([r["text"] for r in learned.collect()])))
    assert len(codes) > 3_000_000
    assert np.array_equal(toxicity.fit(docs, labels).grams, codes)


def plain_probability(levels, alphabet, gram, k=0):
    """The textbook recursion over dictionaries of gram counts, longest grams first."""
    if k == len(levels):
        return 1 / alphabet
    lower = plain_probability(levels, alphabet, gram[1:], k + 1)
    same = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
    if not same:
        return lower
    once, twice = (sum(n == x for n in levels[k].values()) for x in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    return (max(levels[k].get(gram, 0) - d, 0) + d * len(same) * lower) / sum(same.values())


def as_text(codes):
    return ["".join(chr(int(c) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for c in codes]


def levels_of(texts):
    counted = collections.Counter(g for c in grams_of(texts) for g in as_text(c))
    levels = [counted]
    for _ in range(3):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    return levels


TOXIC = ["you vile fool, you vile liar", "a vile liar you are"] * 2
ORDINARY = ["the cat sat on the mat", "a cat and a hat", "that is that"] * 2 + ["once upon a time", "xyz"]


def test_kneser_ney_equals_the_plain_recursion():
    codes, counts = distinct(np.concatenate(grams_of(ORDINARY)))
    levels, model = levels_of(ORDINARY), KneserNey(codes, counts, 30)
    every = np.concatenate([codes, codes[::3] ^ U(1)])
    want = [plain_probability(levels, 30, g) for g in as_text(every)]
    assert model.probability(every) == pytest.approx(want, rel=1e-9)


def test_toxic_ratios_equal_the_plain_recursion():
    own = [levels_of(t)[0] for t in (TOXIC, ORDINARY)]
    shared = [collections.Counter(g[1:] for g in own[0].keys() | own[1].keys())]
    for _ in range(2):
        shared.append(collections.Counter(g[1:] for g in shared[-1]))
    models = toxicity.ToxicModels(*[distinct(np.concatenate(grams_of(t))) for t in (TOXIC, ORDINARY)])
    alphabet = len({g[-1] for levels in own for g in levels}) + 1
    for got, gram in zip(models.ratios, as_text(models.grams)):
        p = [plain_probability([levels, *shared], alphabet, gram) for levels in own]
        assert got == pytest.approx(np.log(p[0] / p[1]), rel=1e-9)


def test_a_language_model_without_its_table_scores_alike(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over it", "en") for i in range(30)] + [(100 + i, f"der schnelle braune fuchs {i} springt darueber", "de") for i in range(30)]
    docs = spark.createDataFrame([*rows, (None, None, None), (7, "", "en")], "doc_id long, text string, lang string")
    models = [language_id.fit(docs, language_id.LanguageParams(table_bytes=n)) for n in (1 << 20, 0)]
    assert len(models[0].known) and not len(models[1].known)
    got = [sorted(map(tuple, language_id.predict(docs, m).select("doc_id", "lang_pred", F.round("score", 6), F.round("entropy", 4)).na.fill("-").na.fill(-1).collect())) for m in models]
    assert got[0] == got[1] and {r[1] for r in got[0]} == {"en", "de", "und"}


def test_extra_columns_of_any_name(spark, clashing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    docs = clashing.withColumns({"kind": F.lit("k"), "gram": F.lit(1), "toxic": F.lit(9), "f0": F.lit(0)})
    assert language_id.predict(docs, language_id.fit(docs)).count() == 4
    assert toxicity.score_texts(docs, toxicity.fit(docs, labels)).count() == 4


def test_more_grams_than_models_hold_are_an_error(spark, small):
    from codelode.llm import language_id

    with pytest.raises(ValueError, match="max_grams"):
        language_id.fit(small.filter("lang is not null"), language_id.LanguageParams(max_grams=1000))
