"""The index of required literals against a full scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codelode.functions import dims
from codelode.operators import rule_index, scan


@pytest.mark.parametrize(("expression", "want"), [
    (r"subprocess\.call\(.*shell=True.*\)", "subprocess.call("), (r"MD5", "md5"), (r"x?abc+d", "abc"), (r"(abc)def", "abcdef"), (r"(?:ab|cd)efg", "efg"), (r"ab|cd", None),
    (r"a*", None), (r"[abc]+", None), (r"[a[bc]d]efg", None), (r"\Qab\E", None), (r"(?s)abc", None), (r"(?x)a b c", None), (r"\p{L}abc", None), (r"(abc){2}x", "abc"), (r"(abc){0,2}xy", "xy"),
    (r"a.bcd", "bcd"), (r"éabc", "abc"), (r"(?=abcd)xy", "xy"), (r"(unclosed", None), (r"\babc\b", "abc"), ("", None),
])
def test_required_literals(expression, want):
    assert rule_index.required_literal(expression) == want


def _sample(rng, parsed):
    """A text that an expression matches, made from its parts."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += rng.choice([chr(value), chr(value).upper()])
        elif name == "ANY":
            out += rng.choice("ab \"'$")
        elif name == "IN":
            out += chr(value[0][1]) if str(value[0][0]) == "LITERAL" else " " if "SPACE" in str(value[0][1]) else "1"
        elif name == "SUBPATTERN":
            out += _sample(rng, value[3])
        elif name == "BRANCH":
            out += _sample(rng, rng.choice(value[1]))
        elif "REPEAT" in name:
            out += "".join(_sample(rng, value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
    return out


def test_index_agrees_with_full_scan_on_random_lines(spark):
    rng = random.Random(11)
    user = [("python", r"(foo|bar)\d"), ("python", r"exec"), ("python", r"execute_now"), ("go", r"[xyz]{3}"), ("java", r"İx"), ("none", "abc")]
    table = scan.rules(spark)
    more = spark.createDataFrame([(1000 + i, x, "user", "LOW", f"u{i}", r, "HIGH", "Other", "", f"U{i}", f"(?di){r}") for i, (x, r) in enumerate(user)], table.schema)
    table = table.unionByName(more)
    rules = [(r[0], r[4]) for r in dims.RULES] + user
    texts = []
    for i in range(3000):
        language, expression = rng.choice(rules)
        parts = [_sample(rng, re._parser.parse(x)) for x in (expression, rng.choice(rules)[1])]
        text = "".join(rng.choice([" ", "(", "K", "é", "x", p, p[1:], p.swapcase()]) for p in parts for _ in range(3))
        texts.append((i, i, rng.choice([language, language, "ruby", "none", None]), rng.choice([text, text, "", None])))
    lines = spark.createDataFrame(texts, "file_id long, line long, language string, text string").repartition(4)
    got = scan.findings(lines, table).select("file_id", "ord", "matched_text")
    plain = lines.alias("l").join(table.alias("r"), F.expr("l.language = r.language and rlike(text, pattern)")).select("file_id", "ord")
    found, want = sorted(tuple(r)[:2] for r in got.collect()), sorted(map(tuple, plain.collect()))
    assert found == want and len(want) > 500
    pairs, every = rule_index.reached(lines, table).count(), lines.join(table, "language").count()
    assert pairs < every / 5


def test_a_large_rule_table_is_joined_by_language(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 1, "python", "os.system(x)")], "file_id long, line long, language string, text string")
    want = scan.findings(lines, scan.rules(spark)).collect()
    monkeypatch.setattr(rule_index, "MAX_RULES", 5)
    assert scan.findings(lines, scan.rules(spark)).collect() == want and len(want) == 1
