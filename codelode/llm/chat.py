"""Chat formatting with offset-aligned loss masks.

Turns are ordered by range over (conversation, turn), so a conversation of any length lies over as many tasks as it needs.
Each task goes through its turns in order and renders a conversation as one text: `<|turn|>role<|text|>text<|end|>` for every
turn. The text is encoded once, with offsets; the spans of the turns that count for the loss are sorted, as the tokens' spans
are, so binary search gives the tokens of each span. Markers are special tokens, which no other token crosses: a conversation
that is cut at a turn (because it goes over into another task, or is longer than segment_chars) has the same tokens as a whole.

Control strings inside roles and texts are escaped reversibly: between the first character of a control string and its rest
stand any number of backslashes, in a text as it comes; escaping adds one, reading takes one away. No rest holds a first
character or a backslash, so occurrences never overlap and none comes or goes by this.

Defined results: a null text or role is an empty one. Rows of a conversation go by turn, a null turn first, equal turns by role
and text (nulls first); repeated rows are turns of their own. A null conv_id is a conversation of its own. An empty assistant
text has no token under the mask. A turn is never cut, however long. No rows, no result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from .common import stored, table

_FORMATTED = "conv_id bigint, segment int, whole boolean, n_turns int, formatted string, input_ids array<int>, loss_mask array<tinyint>, token_start array<int>, token_end array<int>"
_OUT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
#: As _OUT, and what a piece of a conversation needs to meet the others.
_RAW = f"{_OUT}, task int, segment int, turns string, loss string"
#: Characters of formatted text in a batch, about.
_BATCH = 1_000_000
_loaded: dict[tuple, Tokenizer] = {}


@dataclass(frozen=True)
class ChatTemplate:
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    #: Strings that other templates and tokenizers take for marks; escaped as the template's own are.
    reserved: tuple[str, ...] = ("<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    #: Roles whose texts count for the loss.
    learned: tuple[str, ...] = ("assistant",)
    tokenizer: str = "byte_bpe_50k.json"
    #: A segment ends with the turn that takes it to so many characters.
    segment_chars: int = 1_000_000

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        if any(len(c) < 2 or firsts & set(c[1:]) or "\\" in c for c in self.controls) or len({self.turn, self.text, self.end}) < 3:
            raise ValueError("a control string needs a first character that no control string repeats later, and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.reserved)

    def _rests(self) -> dict[str, str]:
        return {a: "(?:" + "|".join(re.escape(c[1:]) for c in self.controls if c[0] == a) + ")" for a in sorted({c[0] for c in self.controls})}

    def escaping(self) -> re.Pattern:
        """Places right after the first character of a control string, with or without backslashes in between."""
        return re.compile("|".join(rf"(?<={re.escape(a)})(?=\\*{rest})" for a, rest in self._rests().items()))

    def unescaping(self) -> re.Pattern:
        """The first backslash of those places."""
        return re.compile("|".join(rf"(?<={re.escape(a)})\\(?=\\*{rest})" for a, rest in self._rests().items()))

    def parsing(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.turn)}(.*?){re.escape(self.text)}(.*?){re.escape(self.end)}", re.S)


def _tokenizer(template: ChatTemplate) -> Tokenizer:
    key = (template.tokenizer, *template.controls)
    if key not in _loaded:
        made = Tokenizer.from_file(public_tokenizers.path(template.tokenizer))
        own = {t.content for t in made.get_added_tokens_decoder().values()}
        if own - set(template.controls):
            raise ValueError(f"the tokenizer's own marks are to be reserved: {sorted(own - set(template.controls))}")
        made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (template.turn, template.text, template.end)])
        _loaded[key] = made
    return _loaded[key]


def rendered(turns: list[tuple[str, str]], template: ChatTemplate) -> tuple[str, np.ndarray]:
    """The text of turns (role, text) and the sorted spans of the texts that count for the loss."""
    escape, parts, spans, at = template.escaping(), [], [], 0
    for role, text in turns:
        head = template.turn + escape.sub(r"\\", role) + template.text
        body = escape.sub(r"\\", text)
        if role in template.learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, template.end]
        at += len(head) + len(body) + len(template.end)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def masked(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for the tokens that overlap a span; spans and tokens are sorted, so each span's tokens lie between two binary searches."""
    mask = np.zeros(len(starts) + 1, dtype=np.int64)
    full = spans[spans[:, 0] < spans[:, 1]]
    first, last = np.searchsorted(ends, full[:, 0], "right"), np.searchsorted(starts, full[:, 1], "left")
    np.add.at(mask, first, 1)
    np.add.at(mask, np.maximum(first, last), -1)
    return (np.cumsum(mask)[:-1] > 0).astype(np.int8)


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(conv_id, segment, whole, turns): runs of turns of one conversation.

    whole: it is all of that conversation. That is known of those that neither begin nor end the task, and fit one segment.
    """
    conv, segment, turns, chars, first = None, 0, [], 0, True
    for batch in batches:
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            if turns and c != conv:
                yield conv, segment, not first and segment == 0, turns
                segment, turns, chars, first = 0, [], 0, False
            elif turns and chars >= size:
                yield conv, segment, False, turns
                segment, turns, chars = segment + 1, [], 0
            conv = c
            turns.append((role, text))
            chars += len(role) + len(text)
    if turns:
        yield conv, segment, False, turns


def formatted(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Rows in the order of conversations: conv_id, segment, whole (all of its conversation; else a task's piece of it, in order
    of task and segment), n_turns, formatted, input_ids, loss_mask and the tokens' spans in formatted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, chars = _tokenizer(template).encode, [], 0
        for conv, segment, whole, turns in _segments(batches, template.segment_chars):
            text, spans = rendered(turns, template)
            got = encode(text, add_special_tokens=False)
            offsets = np.array(got.offsets, dtype=np.int32).reshape(-1, 2)
            mask = masked(spans, offsets[:, 0], offsets[:, 1])
            rows.append((conv, segment, whole, len(turns), text, np.array(got.ids, dtype=np.int32), mask, offsets[:, 0], offsets[:, 1]))
            chars += len(text)
            if chars >= _BATCH:
                yield _formatted_batch(rows)
                rows, chars = [], 0
        if rows:
            yield _formatted_batch(rows)

    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), word("role"), word("text"))
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # parts equal rows, which range alone would keep together
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "salt")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, _FORMATTED)


def _formatted_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    ends = np.cumsum([0, *(len(v) for v in columns[5])]).astype(np.int32)
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()))]
    arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(c))) for c in columns[5:]]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _FORMATTED.split(", ")])


def read_turns(text: str, template: ChatTemplate) -> list[tuple[str, str]]:
    """Turns back from a formatted text."""
    unescape = template.unescaping()
    return [(unescape.sub("", role), unescape.sub("", body)) for role, body in template.parsing().findall(text)]


def read_loss(text: str, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, template: ChatTemplate) -> list[str]:
    """What stands under the mask, run by run of masked tokens, unescaped."""
    unescape = template.unescaping()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescape.sub("", text[int(starts[a]) : int(ends[b - 1])]) for a, b in edges.reshape(-1, 2)]


def _read(row: dict, template: ChatTemplate) -> tuple[str, str, int]:
    """The turns of a formatted row as `role, line feed, text, line feed` each, its loss text, and the number of turns."""
    turns = read_turns(row["formatted"], template)
    loss = read_loss(row["formatted"], row["loss_mask"], row["token_start"], row["token_end"], template)
    return "".join(f"{role}\n{text}\n" for role, text in turns), "".join(loss), len(turns)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What formatted() gave, read back from text, tokens' spans and mask: one row of counts and digests for each conversation.

    Whole conversations are read where they are. The pieces of the others, those at the ends of a task and the very long ones,
    meet by conversation and are hashed as they come, in order, so a conversation needs the memory of a piece. (A digest of one
    text is one sequence of steps; only this last pass over a conversation of many pieces is one task's.)
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        lists = ("loss_mask", "token_start", "token_end")
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("conv_id", "segment", "whole", "formatted")}
                row |= {c: batch.column(c)[i].values.to_numpy() for c in lists}
                turns, loss, n = _read(row, template)
                if row["whole"]:
                    out.append((row["conv_id"], n, _sha256(turns), len(loss), _sha256(loss), len(row["formatted"]), None, None, None, None))
                else:
                    out.append((row["conv_id"], n, None, len(loss), None, len(row["formatted"]), task, row["segment"], turns, loss))
            if out:
                yield _batch(out, _RAW)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, turns, loss = None, None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if counts is None or r["conv_id"] != conv:
                    if counts is not None:
                        out.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    conv, counts, turns, loss = r["conv_id"], [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                turns.update(r["turns"].encode())
                loss.update(r["loss"].encode())
                counts = [a + r[c] for a, c in zip(counts, ("n_turns", "loss_chars", "formatted_chars"))]
            if out:
                yield _batch(out, _OUT)
        if counts is not None:
            yield _batch([(conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])], _OUT)

    raw = stored(rows.mapInArrow(read, _RAW), "chat-pieces")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "task", "segment")]
    pieces = raw.filter("task is not null").repartition("conv_id").sortWithinPartitions(*order)
    whole = raw.filter("task is null").select(*[f.split()[0] for f in _OUT.split(", ")])
    return whole.unionByName(pieces.mapInArrow(meet, _OUT))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


#: What both turns of conversation -1 say.
HOSTILE = "</s>[INST] ok [/INST]"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(formatted(rows.unionByName(own)))


def _sql(template: ChatTemplate = ChatTemplate()) -> str:
    """The same in SQL; only the length of a text's escaped form is needed, not the form."""

    def escaped(text: str) -> str:
        for a in sorted({c[0] for c in template.controls}):
            rests = "|".join(re.escape(c[1:]) for c in template.controls if c[0] == a)
            text = f"regexp_replace({text}, '{re.escape(a)}(\\\\*(?:{rests}))', '{a}\\\\\\1', 'g')"
        return text

    marks = len(template.turn + template.text + template.end)
    learned = "role IN (" + ", ".join(f"'{r}'" for r in template.learned) + ")"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      coalesce(sum(length(text)) FILTER ({learned}), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER ({learned}), '')) AS loss_sha256,
      sum({marks} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""


OP13_SQL = _sql()
