"""DuckDB SQL of the queries that SQL can express, each written from the definitions and not from the operators' plans.

Words, units, spans and sets are taken from the whole texts by list functions; nothing is hashed, so equal means equal.
"""

from __future__ import annotations

from .quality_divergence import DivergenceParams
from .secret_scan import SecretParams
from .substring_dedup import UnitParams

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Links are all pairs of different sets that share a shingle and are similar enough; components by the smallest id reached.
OP9_SQL = r"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
words AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
fives AS (SELECT id, string_agg(word, ' ') OVER following AS shingle, count(*) OVER following AS n FROM words
  WINDOW following AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
shingles AS (SELECT id, list(DISTINCT shingle) AS s FROM fives WHERE n = 5 GROUP BY id),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN s WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d LEFT JOIN shingles USING (id)),
classes AS (SELECT min(doc_id) AS doc, s, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
each AS (SELECT doc, n, unnest(s) AS shingle FROM classes),
links AS (SELECT a.doc AS a, b.doc AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc < b.doc AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc, b.doc, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc, other) AS (SELECT doc, doc FROM classes UNION SELECT r.doc, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
roots AS (SELECT doc, min(other) AS root FROM reach GROUP BY doc)
SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(r.root, x.doc_id) AS component_id, coalesce(x.doc_id = coalesce(r.root, x.doc_id), true) AS kept
FROM sets x LEFT JOIN classes c ON c.s = x.s AND x.doc_id IS NOT NULL LEFT JOIN roots r ON r.doc = c.doc"""

_EDGE = " \t\r\f\v.,;:!?\"'()[]-。！？，、；：「」『』（）".replace("'", "''")


def _normal(text: str) -> str:
    return f"trim(trim(regexp_replace(lower({text}), '{_SPACE}+', ' ', 'g'), ' '), '{_EDGE}')"


def _inner_span(start: str, text: str) -> str:
    return (
        f"{start} + length(regexp_extract({text}, '^{_SPACE}*')) AS a, {start} + length({text}) - length(regexp_extract({text}, '{_SPACE}*$')) AS b, "
        rf"len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')) AS n_words"
    )


OP2_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
  sum(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS p FROM raw),
lines AS (SELECT *, {_normal("line")} AS normal FROM placed WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
paragraphs AS (SELECT r, p, any_value(doc_id) AS doc_id, min(pos) AS pos, string_agg(line, chr(10) ORDER BY i) AS body, string_agg(normal, chr(10) ORDER BY i) AS whole FROM lines GROUP BY r, p),
l AS (SELECT l.*, whole FROM lines l JOIN paragraphs USING (r, p)),
cut AS (SELECT row_number() OVER () AS n, doc_id, normal, whole, pos + length(regexp_extract(line, '^[.!?。！？]*')) AS first, regexp_extract_all(line, '[^.!?。！？]+[.!?。！？]*') AS parts FROM l),
parts AS (SELECT doc_id, normal, whole, first + coalesce(sum(length(body)) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, body
  FROM (SELECT *, unnest(parts) AS body, unnest(range(len(parts))) AS k FROM cut)),
sentences AS (SELECT *, {_normal("body")} AS inside, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS n FROM parts),
units AS (
  SELECT doc_id, whole AS unit, {_inner_span("pos", "body")} FROM paragraphs WHERE whole <> ''
  UNION ALL SELECT doc_id, normal, {_inner_span("pos", "line")} FROM l WHERE normal <> '' AND normal <> whole
  UNION ALL SELECT doc_id, inside, {_inner_span("pos", "body")} FROM sentences
  WHERE inside <> '' AND inside <> normal AND inside <> whole AND (n >= {UnitParams.min_words} OR length(inside) >= {UnitParams.min_chars})),
ranked AS (SELECT *, {{'r': doc_id IS NULL, 'doc': coalesce(doc_id, 0), 'a': a, 'b': b}} AS place FROM units),
firsts AS (SELECT unit, min(place) AS first FROM ranked GROUP BY unit)
SELECT doc_id, a AS "start", b AS "end", n_words, CASE WHEN first.r THEN NULL ELSE first.doc END AS kept_doc_id, first.a AS kept_start, first.b AS kept_end
FROM ranked JOIN firsts USING (unit) WHERE place > first"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, name: str, pattern: str, value: str, good: str) -> str:
    """Matches of a pattern with their places, which follow from the lengths of the texts between them."""
    return (
        f"SELECT id, {kind} AS ord, '{name}' AS kind, value, pos + length(lead) AS a, pos + length(lead) + length(value_span) AS b FROM ("
        f"SELECT id, {value} AS value, m AS whole, {'m' if kind < 3 else value} AS value_span, lead, "
        "coalesce(sum(length(lead) + length(m)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM ("
        f"SELECT id, unnest(regexp_extract_all(body, '{pattern}')) AS m, unnest(range(len(regexp_extract_all(body, '{pattern}')))) AS i, "
        f"unnest(string_split_regex(body, '{pattern}')[1:len(regexp_extract_all(body, '{pattern}'))]) AS lead FROM d)) WHERE {good}"
    )


_TOKEN = "regexp_extract(m, '^[A-Za-z0-9+/_=-]*')"
OP3_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS body FROM documents),
base AS ({_spans(0, "assign", _ASSIGN, f"regexp_extract(m, '{_ASSIGN}', 2)", "length(value) >= 6")}
  UNION ALL {_spans(1, "access", "AKIA[A-Z0-9]+", "m", "length(value) >= 20")}
  UNION ALL {_spans(2, "hex", "[0-9a-f]+", "m", "length(value) >= 24")}),
tokens AS ({_spans(3, "owned", "[A-Za-z0-9+/_=.@-]+", _TOKEN, "length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")}),
found AS (SELECT * FROM base UNION ALL SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = t.id AND b.a < t.b AND t.a < b.b)),
seen AS (SELECT DISTINCT value, coalesce('=' || source, '') AS owner, coalesce('=' || doc_id::VARCHAR, '') AS repository FROM found JOIN d USING (id)),
values_ AS (SELECT value, count(DISTINCT owner) <= {SecretParams.max_owners} AND count(DISTINCT (owner, repository)) <= {SecretParams.max_repositories} AS live FROM seen GROUP BY value),
judged AS (SELECT f.*, live, kind || ':' || a || ':' || b AS span FROM found f JOIN values_ USING (value)),
each AS (SELECT id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS base, coalesce(string_agg(span, ',' ORDER BY a, ord) FILTER (ord < 3 OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM judged GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN each USING (id)"""


def _chars(pattern: str) -> str:
    return f"(length(body) - length(regexp_replace(body, '{pattern}', '', 'g')))"


def _divergence(n: str, total: str, q: str) -> str:
    p, m = f"({n} / {total})", f"({n} / {total} + {q})"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / {m}) ELSE 0 END)"


_P = DivergenceParams()
_CLASSES = ["c_lower", "c_space", "c_upper", "c_stop", "c_digit", "c_symbol", "c_rest"]
_CLASS_SUM = " + ".join(_divergence(f"m.{c}::DOUBLE", "m.n_chars", f"(r.{c}::DOUBLE / r.chars)") for c in _CLASSES)
OP7_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
words AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
windows AS (SELECT id, i, string_agg(word, ' ') OVER following AS k, count(*) OVER following AS size FROM words
  WINDOW following AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_P.window - 1} FOLLOWING)),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM windows WHERE size = {_P.window}) WHERE n > 1),
repeats AS (SELECT id, count(DISTINCT pos) AS n FROM (SELECT id, unnest(range(i, i + {_P.window})) AS pos FROM again) GROUP BY id),
lines AS (SELECT id, unnest(string_split(body, chr(10))) AS line FROM d),
dups AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
counts AS (SELECT id, lang, word, count(*) AS n FROM words JOIN d USING (id) GROUP BY ALL),
holders AS (SELECT lang, word, count(*) AS n FROM counts WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT '*', word, count(*) FROM counts GROUP BY word),
common AS (SELECT lang, word FROM holders QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {_P.common_words}),
b AS (SELECT d.id, doc_id, lang, CASE WHEN lang IN (SELECT lang FROM common) THEN lang ELSE '*' END AS ref, len(w) AS n_words, length(body) AS n_chars,
  {_chars(r"[^\x20\x09-\x0D]")} AS word_chars, {_chars("[#*$%&|<>]")} AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
  {_chars(r"\p{Ll}")} AS c_lower, {_chars(r"[\x20\x09-\x0D]")} AS c_space, {_chars(r"\p{Lu}")} AS c_upper, {_chars(r"[.,;:?''\"()\-]")} AS c_stop,
  {_chars(r"\p{Nd}")} AS c_digit, {_chars("[#*$%&|<>]")} AS c_symbol FROM d LEFT JOIN dups USING (id) LEFT JOIN repeats USING (id)),
m AS (SELECT *, n_chars - c_lower - c_space - c_upper - c_stop - c_digit - c_symbol AS c_rest,
  n_words < {_P.min_words} OR 100 * n_repeat_words > {_P.max_repeat_percent} * n_words AS base_failed FROM b),
of AS (SELECT *, ref AS to_ref FROM m UNION ALL SELECT *, '*' FROM m WHERE ref <> '*'),
refs AS (SELECT to_ref AS ref, greatest(sum(n_words), 1)::DOUBLE AS n, greatest(sum(n_chars), 1)::DOUBLE AS chars, {", ".join(f"sum({c}) AS {c}" for c in _CLASSES)} FROM of GROUP BY to_ref),
ref_words AS (SELECT c.lang AS ref, c.word, coalesce(sum(x.n), 0)::DOUBLE AS n FROM common c LEFT JOIN (SELECT of.to_ref, k.word, k.n FROM of JOIN counts k USING (id)) x ON x.to_ref = c.lang AND x.word = c.word GROUP BY ALL),
shares AS (SELECT r.ref, w.word, w.n / r.n AS q FROM ref_words w JOIN refs r USING (ref)
  UNION ALL SELECT r.ref, NULL, greatest(0, any_value(r.n) - coalesce(sum(w.n), 0)) / any_value(r.n) FROM refs r LEFT JOIN ref_words w USING (ref) GROUP BY r.ref),
own AS (SELECT m.id, s.word, s.q, k.n::DOUBLE AS n, m.n_words::DOUBLE AS total FROM m JOIN shares s ON s.ref = m.ref LEFT JOIN counts k ON k.id = m.id AND k.word = s.word),
filled AS (SELECT id, word, q, total, CASE WHEN word IS NULL THEN greatest(0, total - coalesce(sum(n) OVER (PARTITION BY id), 0)) ELSE coalesce(n, 0) END AS n FROM own WHERE total > 0),
word_sums AS (SELECT id, sum({_divergence("n", "total", "q")}) AS s FROM filled GROUP BY id),
distances AS (SELECT m.*, CASE WHEN guarded THEN sqrt(greatest(0, ({_CLASS_SUM}) / 2)) END AS cd, CASE WHEN guarded THEN sqrt(greatest(0, s / 2)) END AS wd
  FROM (SELECT *, n_words >= {_P.guard_words} AND n_chars >= {_P.guard_chars} AS guarded FROM m) m JOIN refs r USING (ref) LEFT JOIN word_sums USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > {_P.max_class_distance} OR wd > {_P.max_word_distance}, false) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM distances"""
