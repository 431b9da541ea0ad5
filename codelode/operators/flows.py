"""Flows, their normal form, training texts, decisions and metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims, ladders
from ..session import kept


def extracted(code: Column, language: Column) -> Column:
    """Struct source, sink, sanitization by keywords of three languages; a safe default otherwise."""
    low = F.lower(code)
    has = lambda word: F.contains(low, F.lit(word))
    flow = lambda a, b, c: F.struct(F.lit(a).alias("source"), F.lit(b).alias("sink"), F.lit(c).alias("sanitization"))
    java = (language == "java") & has("request.getparameter") & has("statement.execute")
    python = (language == "python") & has("input(") & has("os.system")
    script = (language == "javascript") & has("document.location") & has("innerhtml")
    return (
        F.when(java & ~has("preparedstatement"), flow("request.getParameter", "Statement.execute", "none"))
        .when(java, flow("request.getParameter", "PreparedStatement.execute", "parameterized"))
        .when(python & ~has("shlex.quote"), flow("input()", "os.system", "none"))
        .when(python, flow("input()", "os.system", "shlex.quote"))
        .when(script & ~has("textcontent"), flow("document.location", "element.innerHTML", "none"))
        .when(script, flow("document.location", "element.textContent", "safe"))
        .otherwise(flow("internal", "safe_operation", "sanitized"))
    )


def training_texts(labels: DataFrame) -> DataFrame:
    """idx, label, text: each label's flow texts in turn, by position. labels: doc_id, label.

    Positions are global and unbounded, so they come from counts per range of ids, not from one sorted task.
    """
    ranged = labels.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("doc_id", "label")))
    ranged = kept(ranged)
    # one row a partition
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select("_p", F.coalesce(earlier, F.lit(0)).alias("before"))
    df = ranged.join(F.broadcast(before), "_p").withColumn("idx", F.col("before") + F.col("_n") - 1)
    made = {k: F.array(*[ladders.flow_text(*[F.lit(x) for x in t]) for t in v]) for k, v in dims.FLOW_TEXTS.items()}
    turn = (F.col("idx") % 6 + 1).cast("int")
    return df.select("idx", "label", F.when(F.col("label") == 1, F.element_at(made[1], turn)).otherwise(F.element_at(made[0], turn)).alias("text"))


def fitted_classifier(train: DataFrame):
    """A text classifier on flow texts (text, label)."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train)


def metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; a division by zero gives 0."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    c = df.agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    safe = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select("tn", "fp", "fn", "tp", safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def change_set_decision(predictions: DataFrame) -> DataFrame:
    """One row: BLOCK if any vulnerable prediction is sure beyond 0.8, REVIEW_REQUIRED if any is vulnerable, else APPROVE."""
    sure = F.coalesce(F.bool_or(F.col("vulnerable") & (F.col("confidence") > 0.8)), F.lit(False))
    return predictions.agg(F.when(sure, "BLOCK").when(F.coalesce(F.bool_or("vulnerable"), F.lit(False)), "REVIEW_REQUIRED").otherwise("APPROVE").alias("decision"))


def rule_predictions(asked: DataFrame) -> DataFrame:
    """Adds vulnerable and confidence to flows (source, sink, sanitization): a fixed rule in place of a trained model.

    After the normal form, a flow without sanitization is vulnerable for certain when its source or sink is a known one
    and likely otherwise; an unknown sanitization is safe, with little certainty.
    """
    source, sink, clean = ladders.normalized_flow(F.col("source"), F.col("sink"), F.col("sanitization"))
    known = source.isin([v for _, v in dims.FLOW_SOURCES]) | sink.isin([v for _, v in dims.FLOW_SINKS])
    confidence = F.when((clean == "none") & known, 0.95).when(clean == "none", 0.75).when(clean == "unknown", 0.6).otherwise(0.9)
    return asked.withColumns({"vulnerable": clean == "none", "confidence": confidence})


def predicted(asked: DataFrame, model, normalize: bool = True) -> DataFrame:
    """Adds predicted_class, vulnerable, confidence, vulnerability_score, safe_score and input_used by a fitted classifier."""
    parts = [F.col("source"), F.col("sink"), F.col("sanitization")]
    source, sink, clean = ladders.normalized_flow(*parts) if normalize else parts
    df = model.transform(asked.withColumn("text", ladders.flow_text(source, sink, clean)))
    p = vector_to_array("probability")
    df = df.withColumn("_p", p).withColumn("predicted_class", F.col("prediction").cast("int"))
    return df.withColumns(
        {
            "vulnerable": F.col("predicted_class") == 1, "confidence": F.get("_p", F.col("predicted_class")), "vulnerability_score": F.get("_p", F.lit(1)),
            "safe_score": F.get("_p", F.lit(0)), "input_used": F.col("text"),
        }
    ).drop("_p", "text", "words", "features", "rawPrediction", "probability", "prediction")


def first_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by position in the given order (all of them where there are fewer)."""
    return rows.orderBy(*order).limit(n)


def code_decisions(files: DataFrame, predict=rule_predictions) -> DataFrame:
    """file_id, filename, language, source, sink, sanitization, vulnerable, confidence, decision, action, priority, reason
    of files (file_id, filename, code): the short way from a file to a decision, by one flow a file."""
    language = ladders.by_suffix(F.col("filename"), dims.SIMPLE_SUFFIXES, dims.OTHER_SUFFIX)
    df = files.withColumn("language", language)
    df = predict(df.select("file_id", "filename", "language", extracted(F.col("code"), F.col("language")).alias("f")).select("file_id", "filename", "language", "f.*"))
    chosen = ladders.get_decision(F.col("vulnerable"), F.col("confidence"))
    df = df.withColumns({"_d": chosen, "reason": ladders.decision_reason(F.col("vulnerable"), F.col("confidence"))})
    return df.select("file_id", "filename", "language", "source", "sink", "sanitization", "vulnerable", "confidence", "_d.decision", "_d.action", "_d.priority", "reason")
