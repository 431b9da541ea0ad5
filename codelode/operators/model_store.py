"""The trained classifier on disk: saving, exporting, checking, loading, and what is said of its state."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of the classes.
LABELS = {0: "SAFE", 1: "VULNERABLE"}
_CARD = "model_card"


class ModelLoadError(Exception):
    """A model that is not there, not whole, or not of the shape that was asked for."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def saved(model: PipelineModel, spark: SparkSession, path: str, metrics: dict | None = None) -> str:
    """Writes the model and a card (features, labels, metrics) beside it; returns the path. What is there is replaced."""
    model.write().overwrite().save(f"{path}/model")
    card = {"n_features": model.stages[-1].numFeatures, "labels": LABELS, "metrics": metrics or {}}
    spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{_CARD}")
    return path


def status(spark: SparkSession, path: str, n_features: int | None = None) -> str:
    """Whether a model can be loaded from path, and what is missing if not."""
    if not _exists(spark, path):
        return "MODEL_MISSING"
    if not _exists(spark, f"{path}/{_CARD}"):
        return "INCOMPLETE_MODEL"
    if not _exists(spark, f"{path}/model"):
        return "NO_MODEL_WEIGHTS"
    if n_features is not None and card(spark, path)["n_features"] != n_features:
        return "ARCHITECTURE_MISMATCH"
    try:
        PipelineModel.load(f"{path}/model")
    except Exception:  # whatever the reader makes of a damaged folder
        return "LOAD_FAILED"
    return "MODEL_LOADED"


def card(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{_CARD}").first()["value"])


def loaded(spark: SparkSession, path: str, n_features: int | None = None) -> PipelineModel:
    got = status(spark, path, n_features)
    if got != "MODEL_LOADED":
        raise ModelLoadError(f"{got}: {path}")
    return PipelineModel.load(f"{path}/model")


def exported(spark: SparkSession, path: str, target: str) -> bool:
    """Copies a saved model for use elsewhere and says whether the copy can be loaded."""
    saved(loaded(spark, path), spark, target, card(spark, path)["metrics"])
    return status(spark, target) == "MODEL_LOADED"


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: path, status, n_features, labels, metrics."""
    got = status(spark, path)
    c = card(spark, path) if got not in ("MODEL_MISSING", "INCOMPLETE_MODEL") else {"n_features": 0, "labels": {}, "metrics": {}}
    df = spark.createDataFrame([(path, got, c["n_features"], json.dumps(c["labels"]), json.dumps(c["metrics"]))], "path string, status string, n_features int, labels string, metrics string")
    return df.withColumn("loaded", F.col("status") == "MODEL_LOADED")
