"""Language detection by file name, interpreter line and content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, ladders


def by_extension(filename: Column) -> Column:
    low, out = F.lower(filename), F.when(F.lower(filename).endswith(".cs"), F.lit(None))
    for language, endings in dims.EXTENSIONS.items():
        out = out.when(reduce(lambda a, b: a | b, [low.endswith(e) for e in endings]), language)
    return out


def by_shebang(code: Column) -> Column:
    first = ladders.stripped(F.substring_index(ladders.stripped(code), "\n", 1))
    out = None
    for word, language in dims.SHEBANGS:
        hit = first.rlike(rf"(?i)^#!.*\b{word}")
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out


def content_scores(code: Column) -> dict[str, Column]:
    """Weighted pattern counts of each language over the first 100 lines."""
    sample = F.substring_index(code, "\n", 100)
    out = {language: F.lit(0) for language in dims.LANGUAGES}
    for language, weight, pattern in dims.LANGUAGE_PATTERNS:
        out[language] = out[language] + F.regexp_count(sample, F.lit("(?dmi)" + pattern)) * weight
    return out


def with_content(files: DataFrame) -> DataFrame:
    """Adds content_language (null under a score of 2) and content_confidence."""
    scored = content_scores(F.col("code"))
    df = files.withColumn("_s", F.array(*[F.struct(scored[x].cast("int").alias("score"), F.lit(-i).alias("o"), F.lit(x).alias("language")) for i, x in enumerate(dims.LANGUAGES)]))
    df = df.withColumn("_best", F.array_max("_s")).withColumn("_total", F.aggregate("_s", F.lit(0), lambda a, s: a + s["score"]))
    enough = (F.length(ladders.stripped(F.col("code"))) >= 10) & (F.col("_best.score") >= 2)
    confidence = F.least(F.lit(1.0), F.col("_best.score") / F.greatest(F.lit(10.0), F.col("_total") / 3))
    shebang = by_shebang(F.col("code"))
    return df.select(
        *files.columns,
        F.when(shebang.isNotNull(), shebang).when(enough, F.col("_best.language")).alias("content_language"),
        F.when(shebang.isNotNull(), 0.95).when(enough, confidence).otherwise(0.0).alias("content_confidence"),
    )


def detected(files: DataFrame) -> DataFrame:
    """Adds language and confidence: name and content agreeing, disagreeing, or only one of them."""
    df = with_content(files).withColumn("ext", by_extension(F.col("filename")))
    cs, ext, content, c = F.lower("filename").endswith(".cs"), F.col("ext"), F.col("content_language"), F.col("content_confidence")
    language = F.when(cs, F.lit(None)).otherwise(F.coalesce(ext, content))
    confidence = (
        F.when(cs, 0.0)
        .when(ext.isNotNull() & content.isNotNull() & (ext == content), F.greatest(F.lit(0.9), c))
        .when(ext.isNotNull() & content.isNotNull(), 0.7)
        .when(ext.isNotNull(), 0.8)
        .when(content.isNotNull(), c)
        .otherwise(0.0)
    )
    return df.withColumns({"language": language, "confidence": confidence})


def gated(files: DataFrame, least: float = 0.7) -> DataFrame:
    """Adds status and reason: files whose language is unsure or not supported go no further."""
    df = detected(files)
    supported = F.lower("language").isin(dims.LANGUAGES)
    reason = F.when(F.col("confidence") < least, "Low confidence").when(~F.coalesce(supported, F.lit(False)), "Unsupported language")
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "SUPPORTED").otherwise("UNSUPPORTED_LANGUAGE"))


def extensions(spark: SparkSession) -> DataFrame:
    """language, extension: the languages that are reviewed and the endings of their files."""
    return spark.createDataFrame([(x, e) for x, ends in dims.EXTENSIONS.items() for e in ends], "language string, extension string")
