"""Training as described: a vocabulary, encodings of fixed length, and the best of several fits by F1 on texts kept apart."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flows

#: Lengths of encodings to train with and to ask with, and the ids of what is no token of the vocabulary.
TRAIN_LENGTH, ASK_LENGTH = 128, 256
SPECIAL = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}
TOKEN = r"[a-z0-9_]+|[^a-z0-9_\x20\x09-\x0D]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def vocabulary(texts: DataFrame, size: int = 30_000) -> DataFrame:
    """token, id: the most frequent tokens of texts (text), ties in their order; a table of at most size rows."""
    counts = texts.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    most = counts.orderBy(F.desc("n"), "token").limit(size - len(SPECIAL))
    # the limit bounds the rows that one task numbers
    place = F.row_number().over(W.orderBy(F.desc("n"), "token"))
    return most.select("token", (place + len(SPECIAL) - 1).alias("id"))


def encoded(texts: DataFrame, known: DataFrame, length: int = TRAIN_LENGTH) -> DataFrame:
    """texts with input_ids and attention_mask of that length: [CLS], the first tokens, [SEP], then [PAD].

    known: a vocabulary, whose size bounds it. A null text is an empty one.
    """
    rows = texts.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.posexplode(F.slice(tokens(F.col("text")), 1, length - 2)).alias("_i", "token"))
    ids = each.join(F.broadcast(known), "token", "left").select("_row", F.struct("_i", F.coalesce("id", F.lit(SPECIAL["[UNK]"])).alias("id")).alias("t"))
    ids = ids.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["id"]).alias("_ids"))
    df = rows.join(ids, "_row", "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<int>")))
    whole = F.concat(F.array(F.lit(SPECIAL["[CLS]"])), F.col("_ids"), F.array(F.lit(SPECIAL["[SEP]"])))
    pad = lambda value: F.array_repeat(F.lit(value), length - 2 - F.size("_ids"))
    return df.withColumns({"input_ids": F.concat(whole, pad(SPECIAL["[PAD]"])), "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("_ids") + 2), pad(0))}).drop("_row", "_ids")


#: Strength of the penalty and steps of each fit that is tried.
GRID = [(10.0, 2), (0.1, 20), (0.001, 50)]


def best_fit(train: DataFrame, evaluation: DataFrame, grid=GRID) -> tuple[PipelineModel, dict, list[dict]]:
    """The fit with the highest F1 on the evaluation texts (the first of equals), its metrics, and those of all fits.

    train and evaluation: text, label. Fits are a stated few, each of them a job over the training texts.
    """
    best, said, every = None, None, []
    for penalty, steps in grid:
        stages = [
            RegexTokenizer(inputCol="text", outputCol="words", pattern=TOKEN, gaps=False), HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12), LogisticRegression(maxIter=steps, regParam=penalty),
        ]
        model = Pipeline(stages=stages).fit(train)
        got = flows.metrics(model.transform(evaluation), "label", "prediction").first().asDict() | {"penalty": penalty, "steps": steps}
        every.append(got)
        if said is None or got["f1"] > said["f1"]:
            best, said = model, got
    return best, said, every
