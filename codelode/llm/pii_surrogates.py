"""PII: detection and keyed surrogates.

Entities are e-mail addresses, IPv4 and IPv6 addresses, account numbers (IBAN, by their check digits), payment card numbers,
US social security numbers, telephone numbers, and names after a form of address. A name's given and family part have
surrogates of their own, so `Mr John Smith`, `Mr J Smith` and `Mr Smith` keep one family name; where a text has named
somebody so, the full name, and its parts of three letters or more, are replaced wherever else they stand in it, without a
form of address too. Each value is replaced by one of the same kind and format, by a keyed permutation of all
values of that format: digits stay digits, letters stay letters of the same script and case, punctuation stays. Card
numbers keep length and first digit and get a valid check digit if they had one, account numbers keep country and shape and
get valid check digits, addresses stay addresses, telephone numbers keep their country code, names get names of the same
gender and script, initials get initials. Equal values (whatever their letter case) get equal surrogates in all documents.

A permutation never maps two values of a format to one, so distinct values stay distinct. What it can do is hit a value
that someone in the corpus has: a check over all detected values finds those, and they are permuted again under the next
number until none is left; a corpus in which that does not settle is an error. Names come from lists and can meet; the
same check finds them, for given and family names by themselves, and they get keyed syllables, more with every try. So do the e-mail addresses that
find no free surrogate of their own length.

The key is the caller's secret: whoever has it can undo the permutations. The query and the pipeline take it from the
setting spark.codelode.pii.key of the session, and use SAMPLE_KEY, which is public, where that is unset.

Defined results: null text stays null with no entities; null ids are kept; overlapping matches go to the earlier kind in
KINDS; of several values with one surrogate the smallest keeps it; repeated rows get equal results; texts of any length
are searched whole; an empty table gives an empty result; extra columns, whatever their names, are kept by pseudonymized
(one with the name it would give to the entities is an error) and ignored by the query.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialized, table

#: Kinds in order of precedence.
_UPPER = r"[^\W\d_a-zà-ÿа-яё]"
_WORD = rf"{_UPPER}(?:[^\W\d_]|['’-](?={_UPPER}))+"
_INITIAL = rf"{_UPPER}\.?"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|[Гг]осподин|[Гг]оспожа|г-н|г-жа)\.?\x20(?:" + rf"{_INITIAL}\x20){{0,2}}{_WORD}(?:\x20(?:{_INITIAL}\x20)?{_WORD})?",
}
#: Kinds of the parts of a name.
PARTS = ("family", "given", "initial")
#: Forms of address by gender, and given and family names for surrogates by gender and script.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "госпожа", "г-жа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "господин", "г-н"]
GIVEN = {
    ("female", "latin"): ["Ada", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hilda", "Irma", "Julia", "Karla", "Linda"],
    ("male", "latin"): ["Albert", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Kurt", "Louis"],
    ("either", "latin"): ["Alex", "Chris", "Dominique", "Kim", "Lou", "Maxime", "Nicola", "Robin", "Sascha", "Toni"],
    ("female", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Егор", "Иван", "Олег", "Павел"],
    ("either", "cyrillic"): ["Саша", "Женя", "Валя"],
}
FAMILY = {
    "latin": ["Abel", "Berger", "Costa", "Duval", "Ernst", "Fontana", "Garner", "Holm", "Ibarra", "Jansen", "Keller", "Laurent", "Moreno", "Novak", "Olsen"],
    "cyrillic": ["Белов", "Громов", "Зимин", "Котов", "Лебедев", "Морозов", "Орлов"],
}
#: Consonants and vowels of the syllables that keep surrogates apart, by script.
SYLLABLES = {"latin": ("bcdfghjklmnpqrstvwxz", "aeiou"), "cyrillic": ("бвгджзклмнпрстфхцчшщ", "аеиоу")}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
#: The kinds whose matches need no further test; characters beyond a match that looks like another kind in which theirs end.
_PLAIN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items() if k not in ("ip6", "iban")))
_REACH = 400
#: A text without any of these has no entity; checked before a text leaves the JVM. What they begin with is asked first, as
#: small letters, the most of a text, begin none but two of them.
_ANY = r"(?=[@0-9+:A-Zог])(?:@|[0-9]{3}|[A-Z]{2}[0-9]{2}|:[0-9A-Fa-f]{0,4}:|\+[0-9]{1,3}[ .-]?[0-9]|[0-9]\.[0-9]+\.[0-9]|(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|осподин|оспожа|г-н|г-жа)\.?\x20)"


#: For tests and checks only.
SAMPLE_KEY = b"surrogate key 1"


@dataclass(frozen=True)
class PiiParams:
    key: bytes
    #: Exceptions (value and number of tries) up to which they are sent to all tasks; beyond, they are joined by document.
    broadcast_rows: int = 100_000
    max_tries: int = 20


def _valid(kind: str, value: str) -> bool:
    """Whether a match is what it looks like, where that can be told."""
    if kind == "ip6":
        try:
            return bool(ipaddress.IPv6Address(value)) and any(c.isdigit() for c in value)
        except ValueError:
            return False
    return kind != "iban" or _iban_rest(canonical(kind, value)) == 1


def _iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _gender(title: str) -> str:
    return "female" if title in FEMALE else "male" if title in MALE else "either"


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def _name_parts(text: str, start: int) -> list[tuple[int, int, str, str]]:
    """Start, end, kind (family, given or initial) and value of the words of a name with its form of address."""
    title, *words = [(m.start() + start, m.end() + start, m.group()) for m in re.finditer(r"[^\x20]+", text)]
    gender, out = _gender(title[2].rstrip(".")), []
    for i, (a, b, word) in enumerate(words):
        if len(word.rstrip(".")) == 1:
            out.append((a, a + 1, "initial", word[0]))
        elif i + 1 < len(words):
            out.append((a, b, "given", f"{gender}|{word.lower()}"))
        else:
            out.append((a, b, "family", f"{_script(word)}|{word.lower()}"))
    return out


def _matches(text: str) -> Iterator[re.Match]:
    """The entities' matches; where one is not what it looks like, what else begins in it."""
    at = 0
    while m := _FIND.search(text, at):
        if not _valid(m.lastgroup, m.group()):
            other = _PLAIN.search(text, m.start(), m.end() + _REACH)
            if other is None or other.start() >= m.end():
                at = m.end()
                continue
            m = other
        yield m
        at = m.end()


def mentions(text: str) -> list[tuple[int, int, str, list[tuple[int, int, str, str]]]]:
    """Start, end and kind of the entities of a text, each with the pieces to be replaced: start, end, kind and canonical value."""
    found, names = [], {}
    for m in _matches(text):
        kind, value = m.lastgroup, m.group()
        if kind == "name":
            pieces = _name_parts(value, m.start())
            whole = [(k, v, text[a:b]) for a, b, k, v in pieces if k != "initial"]
            for k, v, word in whole:
                names.setdefault(word, (k, v))
        else:
            pieces = [(m.start(), m.end(), kind, canonical(kind, value))]
        found.append((m.start(), m.end(), kind, pieces))
    known = sorted((w for w in names if len(w) >= 3), key=lambda w: (-len(w), w))
    if known:
        taken = iter([*found, (len(text) + 1, len(text) + 1, "", [])])
        here, more = next(taken), []
        for m in re.finditer(r"(?<![\w@.-])(?:" + "|".join(map(re.escape, known)) + r")(?![\w@-]|['’]\w\w)", text):
            while here[1] <= m.start():
                here = next(taken)
            if m.end() > here[0]:
                continue
            piece = (m.start(), m.end(), *names[m.group()])
            if more and text[more[-1][1] : m.start()] == " " and more[-1][3][-1][2] == "given":
                more[-1] = (more[-1][0], m.end(), "name", [*more[-1][3], piece])
            else:
                more.append((m.start(), m.end(), "name", [piece]))
        found = sorted([*found, *more])
    return found


def entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities of a text."""
    return [(a, b, k) for a, b, k, _ in mentions(text)]


def values_of(text: str) -> set[tuple[str, str]]:
    """Kind and canonical value of all that is to be replaced in a text."""
    return {(k, v) for _, _, _, pieces in mentions(text) for _, _, k, v in pieces}


def canonical(kind: str, value: str) -> str:
    """What equal values have in common: letter case and the separators of numbers do not count."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"[ .()-]", "", value)
    if kind == "ip6":
        return ipaddress.IPv6Address(value).compressed
    return value.replace(" ", "") if kind == "iban" else value


def plain(kind: str, value: str) -> str:
    """A canonical value in the form of a canonical surrogate."""
    return value.split("|")[-1] if kind in PARTS else value


def _round(key: bytes, label: str, r: int, half: int, size: int) -> int:
    got = hmac.new(key, f"{label}|{r}|{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(got, "big") % size


def permute(key: bytes, label: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): eight unbalanced Feistel rounds over a x b >= size, walked until inside."""
    if size <= 1:
        return x
    a = 1
    while a * a < size:
        a += 1 if a < 64 else a // 8
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in range(8):
            if r % 2 == 0:
                left = (left + _round(key, label, r, right, a)) % a
            else:
                right = (right + _round(key, label, r, left, b)) % b
        x = left * b + right
        if x < size:
            return x


def _permute_format(key: bytes, label: str, text: str) -> str:
    """Permutes digits within digits and ASCII letters within letters; everything else stays. Works on lower case."""
    sizes = [10 if c in "0123456789" else 26 if "a" <= c <= "z" else 1 for c in text]
    total, x = 1, 0
    for c, n in zip(text, sizes):
        if n > 1:
            digit = ord(c) - (97 if n == 26 else 48)
            x, total = x * n + digit, total * n
    shape = "".join("9" if n == 10 else "a" if n == 26 else c for c, n in zip(text, sizes))
    x = permute(key, f"{label}|{shape}", x, total)
    out = []
    for c, n in zip(reversed(text), reversed(sizes)):
        if n > 1:
            x, digit = divmod(x, n)
            out.append(chr(digit + (97 if n == 26 else 48)))
        else:
            out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _syllables(x: int, n: int, script: str) -> str:
    """The last n digits of x to the base of 100, each as a syllable."""
    consonants, vowels = SYLLABLES[script]
    out = []
    for _ in range(n):
        x, digit = divmod(x, len(consonants) * len(vowels))
        out.append(consonants[digit // len(vowels)] + vowels[digit % len(vowels)])
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, number: int = 0) -> str:
    """The canonical surrogate of a canonical value; number tells apart the tries after a collision."""
    label = f"{kind}|{number}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        labels = name.split(".")
        # short local parts of a host can all be somebody's: from the third try on they grow
        extra = _syllables(int.from_bytes(hmac.new(key, f"{label}|{value}".encode(), hashlib.sha256).digest(), "big"), min(2 * (number - 2), 30), "latin") if number >= 3 else ""
        # every label of the host is permuted, but not its last, which names no one
        return f"{_permute_format(key, label + '|' + domain, local)}{extra}@{'.'.join(_permute_format(key, label, x) for x in labels)}.{top}"
    if kind == "ip":
        x = 0
        for part in value.split("."):
            x = x * 256 + int(part)
        x = permute(key, label, x, 2**32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        if _luhn(value[:-1]) == int(value[-1]):
            body = value[0] + _permute_format(key, label + "|valid|" + value[0], value[1:-1])
            return body + str(_luhn(body))
        x = value
        while True:  # walks on until the check digit is wrong again, so valid and invalid numbers never meet
            x = x[0] + _permute_format(key, label + "|" + x[0], x[1:])
            if _luhn(x[:-1]) != int(x[-1]):
                return x
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=\d{10}$)|\+\d{2}|", value).group()
        return code + _permute_format(key, label + "|" + code, value[len(code) :])
    if kind == "ip6":
        return ipaddress.IPv6Address(permute(key, label, int(ipaddress.IPv6Address(value)), 2**128)).compressed
    if kind == "iban":
        body = _permute_format(key, f"{label}|{value[:2]}", value[4:].lower()).upper()
        return f"{value[:2]}{98 - _iban_rest(f'{value[:2]}00{body}'):02d}{body}"
    if kind == "initial":
        letters = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ" if _script(value) == "cyrillic" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        x = letters.find(value)
        return letters[permute(key, label, x if x >= 0 else ord(value) % len(letters), len(letters))]
    if kind in PARTS:
        group, word = value.split("|", 1)
        script = group if kind == "family" else _script(word)
        names = FAMILY[script] if kind == "family" else GIVEN[group, script]
        seed = int.from_bytes(hmac.new(key, f"{label}|{value}".encode(), hashlib.sha256).digest(), "big")
        # lists are short: each try has 10,000 times the names of the one before
        return names[seed % len(names)].lower() + _syllables(seed // 1_000_000, min(2 * number, 30), script)
    return _permute_format(key, label, value)


def dressed(kind: str, value: str, made: str) -> str:
    """Puts a canonical surrogate into the format of the value as it stands: separators and letter case."""
    if kind in ("card", "ssn", "phone"):
        fresh = iter(made.lstrip("+"))
        return "".join(next(fresh) if c.isdigit() else c for c in value)
    if kind == "iban":
        fresh = iter(made)
        return "".join(c if c == " " else next(fresh) for c in value)
    if kind == "ip6":
        return made.upper() if value != value.lower() else made
    if kind in ("family", "given"):
        return made.upper() if value.isupper() else made.capitalize()
    if kind == "email" and value != value.lower():
        # a surrogate that grew is longer than the value only in its local part; the host keeps its letters' places
        at, to = value.rindex("@"), made.rindex("@")
        shape = value[:at] + value[at - 1] * (to - at) + value[at:]
        return "".join(m.upper() if v.isupper() else m for v, m in zip(shape, made))
    return made


def _candidate_text() -> Column:
    return F.when(F.col("text").rlike(_ANY), F.col("text"))


def distinct_values(docs: DataFrame, params: PiiParams) -> DataFrame:
    """kind, value (canonical) of all that is to be replaced in the corpus, once each, with what its surrogate may not be equal
    to (own) and its first surrogate (made)."""
    key = params.key

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = {x for t in frame["text"] for x in values_of(t)}
            yield pd.DataFrame([(k, v, plain(k, v), surrogate(key, k, v)) for k, v in sorted(seen)], columns=["kind", "value", "own", "made"])

    texts = docs.select(_candidate_text().alias("text")).filter("text is not null")
    return texts.mapInPandas(run, "kind string, value string, own string, made string").distinct()


def exceptions(docs: DataFrame, params: PiiParams) -> DataFrame:
    """kind, value, number, made of the values whose first surrogate is somebody's value or another one's surrogate."""
    key = params.key

    @F.pandas_udf(T.StringType())
    def again(kind: pd.Series, value: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, n) for k, v, n in zip(kind, value, number)], dtype=object)

    # an initial stands for many names and tells none apart
    values = materialized(distinct_values(docs, params).filter("kind <> 'initial'"))
    taken = values.select("kind", F.col("own").alias("made")).distinct()
    # what is settled stays as it was written; each round looks at the values in dispute alone
    settled, current, number = [], values.select("kind", "value", "made", F.lit(0).alias("number")), 0
    while True:
        # of several values with one surrogate the smallest keeps it
        owners = current.groupBy("kind", "made").agg(F.min("value").alias("owner"))
        owners = owners.join(taken, ["kind", "made"], "left_anti")
        for piece in settled:
            owners = owners.join(piece.select("kind", "made"), ["kind", "made"], "left_anti")
        judged = current.join(owners, ["kind", "made"], "left").withColumn("good", F.coalesce(F.col("owner") == F.col("value"), F.lit(False))).drop("owner")
        judged = materialized(judged)
        settled.append(judged.filter("good").drop("good"))
        retry = judged.filter("not good").select("kind", "value")
        if retry.isEmpty():
            break
        if number >= params.max_tries:
            raise RuntimeError(f"surrogates still collide after {number} tries: {retry.groupBy('kind').count().collect()}")
        number += 1
        current = materialized(retry.withColumn("number", F.lit(number)).withColumn("made", again("kind", "value", "number")))
    return reduce(DataFrame.unionByName, settled).filter("number > 0").select("kind", "value", "made")


def _replaced(text: str, key: bytes, special: dict[tuple[str, str], str]) -> tuple[str, list[dict]]:
    out, spans, done = [], [], 0
    for start, end, entity, pieces in mentions(text):
        for a, b, kind, value in pieces:
            made = special.get((kind, value)) or surrogate(key, kind, value)
            out += [text[done:a], dressed(kind, text[a:b], made)]
            done = b
        spans.append({"kind": entity, "start": start, "end": end})
    return "".join([*out, text[done:]]), spans


_RESULT = "struct<text:string,entities:array<struct<kind:string,start:bigint,end:bigint>>>"


def session_params(spark: SparkSession) -> PiiParams:
    return PiiParams(key=spark.conf.get("spark.codelode.pii.key", SAMPLE_KEY.decode()).encode())


def pseudonymized(docs: DataFrame, params: PiiParams, entities_column: str = "entities") -> DataFrame:
    """docs with text replaced, and the entities: kind and original code point span of each replaced value."""
    if entities_column in docs.columns:
        raise ValueError(f"docs has a column {entities_column} already")
    key = params.key
    special = materialized(exceptions(docs, params))
    rows = docs.select(F.struct(*docs.columns).alias("row"), _candidate_text().alias("text"))
    if special.limit(params.broadcast_rows + 1).count() <= params.broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["made"] for r in special.collect()})

        @F.pandas_udf(_RESULT)
        def replace(text: pd.Series) -> pd.DataFrame:
            rows = [_replaced(t, key, shared.value) if t is not None else (None, None) for t in text]
            return pd.DataFrame(rows, columns=["text", "entities"])

        out = rows.select("row", replace("text").alias("r"))
    else:

        @F.pandas_udf(_RESULT)
        def replace_own(text: pd.Series, own: pd.Series) -> pd.DataFrame:
            rows = []
            for t, o in zip(text, own):
                mine = {(x["kind"], x["value"]): x["made"] for x in o} if o is not None else {}
                rows.append(_replaced(t, key, mine) if t is not None else (None, None))
            return pd.DataFrame(rows, columns=["text", "entities"])

        @F.pandas_udf("array<struct<kind:string,value:string>>")
        def found(text: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else [{"kind": k, "value": v} for k, v in sorted(values_of(t))] for t in text], dtype=object)

        rows = rows.withColumn("key", F.xxhash64("text"))
        each = rows.filter("text is not null").select("key", F.explode(found("text")).alias("e")).select("key", "e.kind", "e.value").distinct()
        own = each.join(special, ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("kind", "value", "made")).alias("own"))
        out = rows.join(own, "key", "left").select("row", replace_own(F.col("text"), F.col("own")).alias("r"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    kept = [(F.coalesce("r.text", "row.text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(*kept, F.coalesce("r.entities", none).alias(entities_column))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), session_params(spark))
    return out.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), "entities")
