"""Quality rules by distribution divergence (JVM expressions only).

A document is compared with references of its language: the histogram of its character classes and the histogram of
the language's most common words. The measure is the Jensen-Shannon distance (base 2, 0 to 1). Documents under a
minimum length are never judged by divergence, because short histograms are noise. A language's common words are those
that most of its documents hold (letter case counts; ties go by the word); all shares are counted over all documents.

Texts are read twice: once for the common words, once for all measures of each document, which are written down; the
references and the verdicts come from these few numbers.

Defined results: null text counts as no text (no words, base_failed); a null language, or one without a reference, is
compared with the reference of all documents; repeated rows are judged separately and alike, and count each in the
references; texts of any length are measured whole; an empty table gives an empty result; extra columns, whatever their
names, are ignored (the operator reads doc_id, text and lang only) or, with keep, come back whole in column row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table

_ALL = "*"
_SYMBOLS = r"[#*$%&|<>]+"
#: Mark of the first common word, and how many words can have a mark, all within ASCII: half for a language's own, half
#: for those of all documents.
_FIRST, _MOST = 48, 80
#: Places of the table in which a word is looked up by some bits of its hash; doubled where two words meet.
_SLOTS = 512
#: Classes of characters: lower case, white space, upper case, stops, digits, symbols, the rest.
N_CLASSES = 7


@dataclass(frozen=True)
class DivergenceParams:
    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    common_words: int = 40
    guard_words: int = 40
    guard_chars: int = 200
    max_class_distance: float = 0.28
    max_word_distance: float = 0.48
    #: References are a small dimension that every task holds; more languages than this are an error.
    max_languages: int = 10_000

    def __post_init__(self):
        if not 1 <= self.common_words <= _MOST // 2:
            raise ValueError(f"common_words is to be from 1 to {_MOST // 2}: each common word needs a mark of its own")


def _plain(text: Column) -> Column:
    """The text with all white space as spaces and none at its ends."""
    return F.trim(F.regexp_replace(text, r"[\x09-\x0D]+", " "))


def _words(plain: Column) -> Column:
    parts = F.split(plain, " ")
    return F.when(plain == "", F.array().cast("array<string>")).when(F.contains(plain, F.lit("  ")), F.array_remove(parts, "")).otherwise(parts)


def _base(docs: DataFrame, keep: bool) -> DataFrame:
    """doc_id, lang (with keep also all columns of docs, in column row), words, counts of words, lines and characters.

    Each count is taken from the shortest text that still shows it: what is neither lower case nor white space is a few
    hundredths of a text.
    """
    row = [F.struct(*docs.columns).alias("row")] if keep else []
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), *row)
    df = df.withColumn("plain", _plain(F.col("text")))
    df = df.withColumn("words", _words(F.col("plain"))).withColumn("odd", F.regexp_replace("plain", r"[\p{Ll} ]+", ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", F.when(F.contains("text", F.lit("\n")), lines))
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "n_dup_lines": F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("bigint"),
            "n_chars": F.length("text").cast("bigint"),
            "word_chars": F.length(F.replace("plain", F.lit(" "), F.lit(""))).cast("bigint"),
            "n_odd": F.length("odd").cast("bigint"),
            "n_symbols": (F.length("odd") - F.length(F.regexp_replace("odd", _SYMBOLS, ""))).cast("bigint"),
            "n_upper": (F.length("odd") - F.length(F.regexp_replace("odd", r"\p{Lu}+", ""))).cast("bigint"),
            "n_stops": (F.length("odd") - F.length(F.regexp_replace("odd", r"[.,;:?'\"()\-]+", ""))).cast("bigint"),
            "n_digits": (F.length("odd") - F.length(F.regexp_replace("odd", r"\p{Nd}+", ""))).cast("bigint"),
        }
    ).drop("_lines", "text", "odd", "plain")
    rest = F.col("n_odd") - F.col("n_upper") - F.col("n_stops") - F.col("n_digits") - F.col("n_symbols")
    counts = [F.col("word_chars") - F.col("n_odd"), F.col("n_chars") - F.col("word_chars"), *map(F.col, ("n_upper", "n_stops", "n_digits", "n_symbols")), rest]
    return df.withColumn("classes", F.array(*[c.cast("double") for c in counts])).drop("n_odd", "n_upper", "n_stops", "n_digits")


def _with_base_verdict(df: DataFrame, params: DivergenceParams) -> DataFrame:
    """From hashes, the words' hashes: n_repeat_words (words in windows found twice or more) and base_failed."""
    size, part = params.window, -(-params.window // 2)

    def places(of: Column) -> Column:
        return F.sequence(F.lit(0), (F.col("n_words") - of).cast("int"))

    # a window is two half windows; a text in which a window repeats has repeated halves, and at least so many
    halves = F.transform(places(F.lit(part)), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(part)]))
    df = df.withColumn("_v", F.when(F.col("n_words") >= size, halves))
    maybe = F.size(F.array_distinct("_v")) <= F.size("_v") - (size - part + 1)
    windows = F.transform(places(F.lit(size)), lambda i: F.xxhash64(F.get("_v", i), F.get("_v", i + (size - part))))
    df = df.withColumn("_h", F.when(maybe, windows)).drop("_v")
    # few texts repeat a window; only they pay for finding where
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    marked = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(twice, F.sort_array(marked))).drop("_h")
    same = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"])))
    cover = F.transform("_p", lambda p, i: F.least(F.lit(size), F.coalesce(F.get("_p", i + 1) - p, F.lit(size))))
    total = F.aggregate(cover, F.lit(0).cast("bigint"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop("_s", "_p")
    failed = (F.col("n_words") < params.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(params.max_repeat_percent) * F.col("n_words")
    )
    return df.withColumn("base_failed", failed)


def jensen_shannon(counts: Column, total: Column, q: Column) -> Column:
    """Distance (0 to 1) of counts with that total from the distribution q; total is to be a plain column."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(counts, q, lambda n, b: part(n / total, b) + part(b, n / total))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2.0))


def common_words(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> dict[str, list[tuple[str, int]]]:
    """By language, and for all documents ('*'): the words that most documents hold, with their hashes, in order."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select("lang", F.explode(F.array_distinct(_words(_plain(text)))).alias("word"))
    words = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    if words.select("lang").distinct().count() > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages")
    every = words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(_ALL).alias("lang"), "word", "n")
    top, k = words.filter("lang is not null").unionByName(every), params.common_words
    # a power of two that at least k words of the language reach (1 where it has fewer): only those words are ranked
    sizes = top.groupBy("lang", F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n", F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("level"))))
    least = sizes.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("n") >= k, F.pow(F.lit(2), "level"))), F.lit(1)).alias("least"))
    # one row a language, at most max_languages
    top = top.join(F.broadcast(least), "lang").filter(F.col("n") >= F.col("least"))
    # the best of each salt first, so no task ranks all words of a language
    for keys in (["lang", F.pmod(F.xxhash64("word"), F.lit(64))], ["lang"]):
        place = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc("word"))
        top = top.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k)
    out: dict[str, list[tuple[str, int]]] = {_ALL: []}
    for r in top.withColumn("hash", F.xxhash64("word")).orderBy("lang", "_r").collect():
        out.setdefault(r["lang"], []).append((r["word"], r["hash"]))
    return out


def _lookup(hashes: list[int]) -> tuple[int, list[int | None], list[str | None]]:
    """A shift, and by those bits of a hash the hash itself and its mark: no two of the hashes meet."""
    size = _SLOTS
    while True:
        for shift in range(0, 50):
            places = [(h >> shift) & (size - 1) for h in hashes]
            if len(set(places)) == len(set(hashes)):
                held: list[int | None] = [None] * size
                marks: list[str | None] = [None] * size
                for i, (at, h) in enumerate(zip(places, hashes)):
                    held[at], marks[at] = h, chr(_FIRST + i)
                return shift, held, marks
        size *= 2


def measures(docs: DataFrame, vocabulary: dict[str, list[tuple[str, int]]], params: DivergenceParams = DivergenceParams(), keep: bool = False) -> DataFrame:
    """All that the verdict needs of each document: base measures, classes, ref_lang, and counts of the common words of
    that language and after them of those of all documents that are not among them; with keep also its row."""
    spark, every = docs.sparkSession, vocabulary[_ALL]
    both = {x: [h for _, h in words] + [h for w, h in every if (w, h) not in words] for x, words in vocabulary.items()}
    rows = [(x, *_lookup(hashes), len(hashes)) for x, hashes in both.items()]
    tables = spark.createDataFrame(rows, "ref_lang string, _shift int, _held array<bigint>, _marks array<string>, _size int")
    known = tables.filter(F.col("ref_lang") != _ALL).select(F.col("ref_lang").alias("_known"))
    df = _base(docs, keep).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    df = _with_base_verdict(df, params)
    # one row a language, at most max_languages
    df = df.join(F.broadcast(known), F.col("lang") == F.col("_known"), "left").withColumn("ref_lang", F.coalesce("_known", F.lit(_ALL)))
    df = df.join(F.broadcast(tables), "ref_lang")

    def mark(h: Column) -> Column:
        at = F.call_function("shiftright", h, F.col("_shift")).bitwiseAND(F.size("_held") - 1).cast("int")
        return F.when(F.get("_held", at) == h, F.get("_marks", at))

    # each common word becomes one character; the characters are then counted
    df = df.withColumn("_codes", F.array_join(F.transform("hashes", mark), ""))
    seen = lambda i: F.octet_length("_codes") - F.octet_length(F.replace(F.col("_codes"), F.char(i + _FIRST - 1), F.lit("")))
    counts = F.transform(F.sequence(F.lit(1), F.col("_size")), lambda i: seen(i).cast("double"))
    df = df.withColumn("counts", F.when(F.col("_size") > 0, counts).otherwise(F.array().cast("array<double>")))
    kept = ["doc_id", "lang", *(["row"] if keep else [])]
    return df.select(*kept, "n_words", "word_chars", "n_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "ref_lang", "counts")


def references(measured: DataFrame, vocabulary: dict[str, list[tuple[str, int]]]) -> list[dict]:
    """A reference for each language and one (lang '*') of all: class histogram, common words, their histogram.

    Counts cover all documents. What comes to the driver holds languages x common_words numbers, whatever the corpus size.
    """
    names = [("counts", max(len(w) for w in vocabulary.values()) + len(vocabulary[_ALL])), ("classes", N_CLASSES)]
    sums = [F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for c, n in names for i in range(n)]
    out = {x: {"lang": x, "n_words": 0, "classes": [0.0] * N_CLASSES, "counts": {w: 0.0 for w, _ in ws}} for x, ws in vocabulary.items()}
    for r in measured.groupBy("ref_lang").agg(F.sum("n_words").alias("n_words"), *sums).collect():
        own = [w for w, _ in vocabulary[r["ref_lang"]]]
        own += [w for w, _ in vocabulary[_ALL] if w not in own]
        for one in {r["ref_lang"], _ALL}:
            out[one]["n_words"] += r["n_words"]
            out[one]["classes"] = [c + r[f"classes{i}"] for i, c in enumerate(out[one]["classes"])]
            for i, w in enumerate(own):
                if w in out[one]["counts"]:
                    out[one]["counts"][w] += r[f"counts{i}"]
    return list(out.values())


def judged(measured: DataFrame, refs: list[dict], params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """measured with the two distances and the verdict kept."""
    rows = []
    for r in refs:
        seen, n, chars = list(r["counts"].values()), float(max(r["n_words"], 1)), max(sum(r["classes"]), 1.0)
        rows.append((r["lang"], [x / chars for x in r["classes"]], [x / n for x in [*seen, max(0.0, n - sum(seen))]]))
    shares = measured.sparkSession.createDataFrame(rows, "ref_lang string, ref_classes array<double>, ref_shares array<double>")
    # one row a language; the words of all documents that follow a language's own are not compared
    df = measured.join(F.broadcast(shares), "ref_lang", "left").withColumn("counts", F.slice("counts", F.lit(1), F.size("ref_shares") - 1))
    rest = F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate("counts", F.lit(0.0), lambda a, x: a + x))
    df = df.withColumn("_rest", rest).withColumn("_c", F.concat("counts", F.array("_rest")))
    guarded = (F.col("n_words") >= params.guard_words) & (F.col("n_chars") >= params.guard_chars)
    df = df.withColumns(
        {
            "class_distance": F.when(guarded, jensen_shannon(F.col("classes"), F.col("n_chars"), F.col("ref_classes"))),
            "word_distance": F.when(guarded, jensen_shannon(F.col("_c"), F.col("n_words"), F.col("ref_shares"))),
        }
    )
    odd = (F.col("class_distance") > params.max_class_distance) | (F.col("word_distance") > params.max_word_distance)
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def fit_references(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> list[dict]:
    """The references of docs."""
    vocabulary = common_words(docs, params)
    return references(measures(docs, vocabulary, params), vocabulary)


def judge(docs: DataFrame, refs: list[dict], params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """All measures and the verdict of each document, by given references."""
    spark, words = docs.sparkSession, sorted({w for r in refs for w in r["counts"]})
    hashed = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.xxhash64("word").alias("hash")).collect() if words else []
    of = {r["word"]: r["hash"] for r in hashed}
    return judged(measures(docs, {r["lang"]: [(w, of[w]) for w in r["counts"]] for r in refs}, params), refs, params)


def fit_and_judge(docs: DataFrame, params: DivergenceParams = DivergenceParams(), keep: bool = False) -> DataFrame:
    """Fits the references on docs and judges docs with them; the measures are written down between the two."""
    vocabulary = common_words(docs, params)
    measured = stored(measures(docs, vocabulary, params, keep), "measures")
    return judged(measured, references(measured, vocabulary), params)


def quality_divergence(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """Base measures, the two distances and the verdict of each document."""
    return fit_and_judge(docs, params).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    distances = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return quality_divergence(table(spark, sf_dir, "documents")).withColumns(distances)
