"""Ids of many texts under a word-end BPE tokenizer file, equal to the library's, computed per distinct word.

Texts are split at ASCII white space, where no token of this kind of tokenizer crosses; each distinct word of a run is
tokenized once. Words of ASCII and Latin-1 letters go through a vectorised merge loop over all words at once; words with
other characters, with a `<` (special tokens) or of unusual length go to the tokenizers library.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from .wordcodes import text_batches, word_codes, word_spans

_SAFE = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ ]*")
#: Fixed value: the file's own split pattern, over the characters of _SAFE in lower case; a space parts words.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+| ")
_LONG = 200
_NONE = np.int32(2**31 - 1)
_loaded: dict[str, WordBpe] = {}


def ragged(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' parts of flat, one after another, and their offsets."""
    sizes = offsets[rows + 1] - offsets[rows]
    out = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[rows], sizes)
    return flat[at], out


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # the vectorised loop is for files of this kind only; any other goes to the library word by word
        pattern = json.dumps(spec["pre_tokenizer"])
        self.known_kind = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pattern and "Lowercase" in json.dumps(spec["normalizer"])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Applies merges to each row of ids (padded with -1), lowest rank first, leftmost of equals."""
        out = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        if ids.shape[1] == 1:
            return ids
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        column = np.arange(ids.shape[1])[None, :]
        while len(rows):
            p = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), p]
            done = low == _NONE
            if done.any():
                out[rows[done]] = ids[done]
                go = ~done
                rows, ids, rank, p, low = rows[go], ids[go], rank[go], p[go], low[go]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            after = column > p[:, None]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[every, p] = self.made[low]
            rank[:, :-1] = np.where(after[:, :-2], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            inside = p < rank.shape[1]
            rank[every[inside], p[inside]] = self._rank(ids[every[inside], p[inside]], ids[every[inside], p[inside] + 1])
            before = p > 0
            rank[every[before], p[before] - 1] = self._rank(ids[every[before], p[before] - 1], ids[every[before], p[before]])
        return out

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of lower-cased pieces without white space."""
        raw = np.frombuffer(("\n".join(pieces) + "\n").encode(), dtype=np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        sizes = np.zeros(len(pieces), dtype=np.int64)
        parts = []
        i = 0
        while i < len(order):
            width = int(lengths[order[i]])
            j = i + 1
            while j < len(order) and (j - i) < 20_000 and lengths[order[j]] <= width + 1:
                step = min(len(order), j + 256)
                j = step if lengths[order[step - 1]] <= width + 1 else j + 1
            chosen = order[i:j]
            size = lengths[chosen]
            width = int(size[-1])
            grid = starts[chosen][:, None] + np.arange(width)[None, :]
            valid = np.arange(width)[None, :] < size[:, None]
            bytes_ = raw[np.minimum(grid, len(raw) - 1)]
            ids = np.where(valid, self.inner[bytes_], -1).astype(np.int32)
            ids[np.arange(len(chosen)), size - 1] = self.last[bytes_[np.arange(len(chosen)), size - 1]]
            merged = self._merge(ids)
            sizes[chosen] = (merged >= 0).sum(axis=1)
            parts.append(merged[merged >= 0])
            i = j
        sorted_sizes = sizes[order]
        sorted_offsets = np.concatenate([[0], np.cumsum(sorted_sizes)])
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return ragged(np.concatenate(parts), sorted_offsets, back)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of words (no ASCII white space inside)."""
        fast = [i for i, w in enumerate(words) if len(w) <= _LONG and _SAFE.fullmatch(w)] if self.known_kind else []
        slow = sorted(set(range(len(words))) - set(fast)) if len(fast) < len(words) else []
        flats, sizes = [], np.zeros(len(words), dtype=np.int64)
        order = np.array([*fast, *slow], dtype=np.int64)
        if fast:
            pieces = _SPLIT.findall(" ".join([words[i] for i in fast]).lower())
            place: dict[str, int] = {}
            at = np.fromiter((-1 if p == " " else place.setdefault(p, len(place)) for p in pieces), dtype=np.int64, count=len(pieces))
            word = np.cumsum(at < 0)[at >= 0]
            flat, offsets = self._pieces(list(place))
            ids, spans = ragged(flat, offsets, at[at >= 0])
            sizes[order[: len(fast)]] = np.bincount(word, weights=np.diff(spans), minlength=len(fast)).astype(np.int64)
            flats.append(ids)
        if slow:
            got = [e.ids for e in self.library.encode_batch([words[i] for i in slow], add_special_tokens=False)]
            sizes[order[len(fast) :]] = [len(g) for g in got]
            flats.append(np.array([x for g in got for x in g], dtype=np.int32))
        offsets = np.concatenate([[0], np.cumsum(sizes[order])])
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return ragged(np.concatenate([np.empty(0, np.int32), *flats]), offsets, back)

    def encode(self, texts: list[str | None], limit: int = 8 << 20):
        """Yields the ids (int32) of each text in turn."""
        for _, _, data, starts in text_batches(texts, limit):
            begin, end = word_spans(data)
            if not len(begin):
                for _ in range(len(starts) - 1):
                    yield np.empty(0, np.int32)
                continue
            codes = word_codes(data, begin, end, lower=False)
            _, first, at = np.unique(codes, return_index=True, return_inverse=True)
            raw = data.tobytes()
            flat, offsets = self.words([raw[begin[i] : end[i]].decode("utf-8", "surrogatepass") for i in first])
            ids, spans = ragged(flat, offsets, at)
            cuts = spans[np.searchsorted(begin, starts)]
            for i in range(len(starts) - 1):
                yield ids[cuts[i] : cuts[i + 1]]


def load(path: str) -> WordBpe:
    """The tokenizer of a file, kept for the life of the process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
