"""Ordered word ladders and small decisions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def ladder(text: Column, rungs: list[tuple[list[str], str]], otherwise: Column | str) -> Column:
    """The value of the first rung of which the lower-cased text contains a word."""
    low, out = F.lower(text), None
    for words, value in rungs:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def category(description: Column) -> Column:
    return ladder(description, dims.CATEGORIES, dims.OTHER_CATEGORY)


def remediation(description: Column) -> Column:
    return ladder(description, dims.REMEDIATIONS, dims.OTHER_REMEDIATION)


def node_type(ast_type: Column) -> Column:
    return ladder(ast_type, dims.NODE_TYPES, dims.OTHER_NODE_TYPE)


def severity_weight(severity: Column) -> Column:
    out = None
    for s, w in dims.SEVERITY_WEIGHTS.items():
        out = F.when(severity == s, w) if out is None else out.when(severity == s, w)
    return out.otherwise(5).cast("bigint")


def security_score(weight: Column) -> Column:
    return F.when(weight <= 30, F.lit(100) - weight).otherwise(F.greatest(F.lit(70) - (weight - 30) * 2, F.lit(0))).cast("int")


def risk_level(weight: Column, n: Column, has: dict[str, Column]) -> Column:
    """By the highest severity present or the weight; no finding at all is LOW."""
    return (
        F.when(n == 0, "LOW")
        .when(has["CRITICAL"] | (weight >= 40), "CRITICAL")
        .when(has["HIGH"] | (weight >= 20), "HIGH")
        .when(has["MEDIUM"] | (weight >= 10), "MEDIUM")
        .when(has["LOW"] | (weight >= 5), "LOW")
        .otherwise("INFO")
    )


def lint_score(errors: Column, warnings: Column, infos: Column) -> Column:
    base = F.greatest(F.lit(0), F.lit(100) - F.least(errors * 15, F.lit(70)) - F.least(warnings * 5, F.lit(25)) - F.least(infos * 2, F.lit(5)))
    return F.when((errors == 0) & (warnings == 0), F.least(F.lit(100), base + 10)).otherwise(base).cast("int")


def overall_score(style: Column, security: Column) -> Column:
    return (style * F.lit(0.4).cast("double") + security * F.lit(0.6).cast("double")).cast("int")


def overall_status(score: Column) -> Column:
    return F.when(score >= 90, "EXCELLENT").when(score >= 75, "GOOD").when(score >= 60, "FAIR").otherwise("POOR")


def final_decision(security: Column, risk: Column, vulnerable: Column, confident: Column) -> Column:
    """The security score and risk decide before the classifier's plain hits; its confident hits decide first."""
    return (
        F.when(confident > 0, "REJECT")
        .when((security < 60) | risk.isin("CRITICAL", "HIGH"), "REJECT")
        .when(vulnerable > 0, "REVIEW_REQUIRED")
        .when(security < 75, "REVIEW_RECOMMENDED")
        .otherwise("APPROVE")
    )


def flow_text(source: Column, sink: Column, sanitization: Column) -> Column:
    return F.format_string("[VULNERABILITY_FLOW]\nSOURCE: %s\nSINK: %s\nSANITIZATION: %s", source, sink, sanitization)


def normalized_flow(source: Column, sink: Column, sanitization: Column) -> list[Column]:
    return [
        ladder(source, dims.FLOW_SOURCES, source).alias("source"),
        ladder(sink, dims.FLOW_SINKS, sink).alias("sink"),
        ladder(sanitization, dims.FLOW_SANITIZERS, sanitization).alias("sanitization"),
    ]


def get_decision(vulnerable: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """Struct of decision, action and priority of one prediction."""
    kinds = [("BLOCK", "Block the pull request", "HIGH"), ("REVIEW", "Request security review", "MEDIUM"), ("ALLOW", "Allow the pull request", "LOW")]
    parts = [F.struct(F.lit(d).alias("decision"), F.lit(a).alias("action"), F.lit(p).alias("priority")) for d, a, p in kinds]
    return F.when(vulnerable & (confidence > threshold), parts[0]).when(vulnerable, parts[1]).otherwise(parts[2])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def recommendations(security: str = "security_score", style: str | None = "style_score", issues: str | None = "issues", scanner_failed: Column | None = None) -> Column:
    """What a review says, in order, from the columns of scores and of the counts grave, vulnerable and confident.

    Where scanner_failed holds, that is said in place of what the scanner would have given.
    """
    said = [F.when(F.col(style) < 70, F.format_string("Improve code style (score: %d/100)", F.col(style)))] if style else []
    said += [
        F.when(F.col(security) < 80, F.format_string("Address security issues (score: %d/100)", F.col(security))),
        F.when(F.col("grave") > 0, F.format_string("Fix %d critical/high security findings", F.col("grave"))),
    ]
    if scanner_failed is not None:
        failed = F.when(scanner_failed, "Security scanner failed - manual review required")
        said = [*said[:-2], failed, *[F.when(~scanner_failed, x) for x in said[-2:]]]
    if issues:
        said.append(F.when(F.col(issues) > 0, F.format_string("Review %d PDG-identified vulnerabilities", F.col(issues))))
    said.append(
        F.when(F.col("confident") > 0, F.format_string("CRITICAL: Model detected %d high-confidence vulnerable patterns", F.col("confident"))).when(
            F.col("vulnerable") > 0, F.format_string("Model detected %d vulnerable patterns (review recommended)", F.col("vulnerable"))
        )
    )
    return F.array_compact(F.array(*said))


def printed(value: Column, digits: int) -> Column:
    """A double with three decimals at most as text, rounded by its exact binary value and ties to even, as SQL, C and Python print it.

    Java's own format rounds the shortest decimal text of the double, and half up: 81.25 gives 81.3 there and 81.2 here.
    """
    scale = 10**digits
    x = value.cast("double")
    # 24 and 29 bits: either part times scale is exact, so the sign of over is, too
    high = x.cast("float").cast("double")
    low, n = x - high, F.floor(x * scale)
    over = high * scale - (n + F.lit(0.5)) + low * scale
    up = (over > 0) | ((over == 0) & (n % 2 != 0))
    exact = F.abs(x) < float(2**51 // scale)
    return F.format_string(f"%.{digits}f", F.when(exact, (n + F.when(up, 1).otherwise(0)).cast("double") / scale).otherwise(x))


def decision_reason(vulnerable: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """Why get_decision decides as it does."""
    said = lambda text: F.format_string(f"{text} vulnerability detected (confidence: %s)", printed(confidence, 3))
    return F.when(vulnerable & (confidence > threshold), said("High confidence")).when(vulnerable, said("Potential")).otherwise("No vulnerability detected")


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest is taken off first, so none overflows."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def by_suffix(filename: Column, endings: list[tuple[str, str]], otherwise: str) -> Column:
    """A plain language map by the end of the file's name."""
    out = None
    for end, language in endings:
        out = F.when(filename.endswith(end), language) if out is None else out.when(filename.endswith(end), language)
    return out.otherwise(otherwise)


def title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
