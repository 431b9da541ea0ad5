"""Index of the literals that rules require: a line is tested only against rules whose literal it holds.

An expression that matches somewhere in a line must find its literal there. The literals of a language form one alternation,
tried at every place of a line (a lookahead takes no characters, so literals that overlap are all found); only the rules so
reached are tested by their own expressions. A rule whose expression requires no literal is tested on all lines.
"""

from __future__ import annotations

import re
from re import _constants as codes
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one table up to which the index is built; a larger table is joined by language alone.
MAX_RULES = 10_000
#: Key of the rules that require no literal.
NONE = ""


def _runs(items) -> list[str]:
    """The runs of characters that every match of a parsed sequence holds; '\\n' parts runs."""
    out, run = [], ""
    for op, value in items:
        if op is codes.LITERAL and value < 128:
            run += chr(value)
            continue
        if op is codes.SUBPATTERN and not value[1] and not value[2]:
            inner = _runs(value[3])
            # a group of characters alone goes on with the run
            if len(value[3]) and all(o is codes.LITERAL and v < 128 for o, v in value[3]):
                run += inner[0]
                continue
            out += [run, *inner]
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _runs(value[2])
            if len(value[2]) == 1 and value[2][0][0] is codes.LITERAL and inner:
                out.append(run + inner[0])
            else:
                out += [run, *inner]
        else:
            out.append(run)
        run = ""
    return [x for x in [*out, run] if x]


def required_literal(expression: str) -> str | None:
    """The longest run of ASCII characters, lower case, that every match of an expression holds in any case; else None.

    Only what both dialects read alike is used: classes in classes, quoting, comments and inline flags give None.
    """
    if re.search(r"\[[^\]]*\[|&&|\\Q|\(\?[a-zA-Z#-]*[xs#-]|\(\?[a-z]+[:)]", expression):
        return None
    try:
        parsed = parser.parse(expression)
    except (re.error, RecursionError, OverflowError):
        return None
    runs = [r for r in _runs(parsed) if len(r) > 1]
    return max(runs, key=len).lower() if runs else None


def keyed(rules: list[tuple[str, str]]) -> list[str]:
    """For rules (language, expression) the literal that each is found by, or NONE.

    No literal of a language begins another: the shorter one stands for both, so at each place one alternative can match.
    """
    found = [(language, required_literal(x)) for language, x in rules]
    own: dict[str, set[str]] = {}
    for language, literal in found:
        if literal:
            own.setdefault(language, set()).add(literal)
    return [min((x for x in own[language] if literal.startswith(x)), key=len) if literal else NONE for language, literal in found]


def _held(language: Column, text: Column, literals: dict[str, list[str]], rest: set[str]) -> Column:
    """The distinct keys of a language's rules that a line reaches."""
    low, out, none = F.lower(text), None, F.array().cast("array<string>")
    for x in sorted({*literals, *rest}):
        always = F.array(F.lit(NONE)) if x in rest else none
        if literals.get(x):
            any_of = "|".join(re.escape(v) for v in literals[x])
            got = F.when(low.rlike(any_of), F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({any_of}))"), F.lit(1)))).otherwise(none)
            always = F.concat(got, always)
        out = F.when(language == x, always) if out is None else out.when(language == x, always)
    return out.otherwise(none) if out is not None else none


def reached(lines: DataFrame, rule_table: DataFrame) -> DataFrame:
    """lines with each rule (its columns, and its language as rule_language) that may match: to be tested by its expression.

    rule_table is a dimension (language, regex, ...); it goes to the driver up to MAX_RULES rows.
    """
    renamed = rule_table.withColumnRenamed("language", "rule_language")
    rows = rule_table.select("language", "regex").distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        return lines.join(renamed, F.col("language") == F.col("rule_language"))
    pairs = [(r["language"], r["regex"]) for r in rows]
    keys = keyed(pairs)
    literals: dict[str, list[str]] = {}
    for (language, _), key in zip(pairs, keys):
        if key != NONE and key not in literals.setdefault(language, []):
            literals[language].append(key)
    rest = {language for (language, _), key in zip(pairs, keys) if key == NONE}
    spark = lines.sparkSession
    known = spark.createDataFrame([(*p, k) for p, k in zip(pairs, keys)], "_language string, _regex string, _key string")
    indexed = renamed.join(F.broadcast(known), (F.col("rule_language") == F.col("_language")) & (F.col("regex") == F.col("_regex"))).drop("_language", "_regex")
    each = lines.withColumn("_held", F.explode(_held(F.col("language"), F.col("text"), literals, rest)))
    hit = (F.col("language") == F.col("rule_language")) & (F.col("_held") == F.col("_key"))
    return each.join(F.broadcast(indexed), hit).drop("_held", "_key")
