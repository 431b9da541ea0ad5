"""Character 4-grams of texts as packed 64-bit codes, and interpolated Kneser-Ney estimates over them.

Texts are lower-cased; every run of characters that are not letters becomes one boundary (code 32), also before the
first letter. A letter takes 16 bits (letters beyond the basic plane are folded), so four make one exact code: its upper
48 bits are the context of three, its lower 48 bits the next shorter gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
ORDER = 4
_GAP = "\x00" * (ORDER - 1)
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def gram_runs(texts: list[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: index of the first, codes of all positions, and each text's first position and end.

    A text's codes depend on that text alone.
    """
    first, parts, total = 0, [], 0
    for i, t in enumerate(texts):
        parts.append((t or "").lower().replace("\x00", " "))
        total += len(parts[-1])
        if total >= limit or i + 1 == len(texts):
            yield (first, *_codes(parts))
            first, parts, total = i + 1, [], 0


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer((_GAP + _GAP.join(parts) + _GAP).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    gaps = (starts[:, None] - np.arange(1, ORDER)[None, :]).ravel()
    keep[gaps] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    folded = np.where(raw > 0xFFFF, (raw ^ (raw >> 13)) & 0xFFFF, raw)
    chars = np.where(letter, folded, 32)[keep].astype(U)
    codes = np.full(len(chars), 0, dtype=U)
    for k in range(ORDER):
        codes[k:] |= chars[: len(chars) - k] << U(16 * k)
    return codes, place[starts], place[starts + lengths]


def distinct(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sum of their counts."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    values, at = np.unique(codes, return_inverse=True)
    return values, np.bincount(at, weights=counts, minlength=len(values)).astype(np.int64)


def lookup(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, codes), max(len(table) - 1, 0))
    return at, (table[at] == codes) if len(table) else np.zeros(len(codes), dtype=bool)


def discount(counts: np.ndarray) -> float:
    """Absolute discount by the numbers of grams seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


class Level:
    """One order's sorted grams with counts, and by context the total and the number of different continuations."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts, self.discount = codes, counts.astype(np.float64), discount(counts)
        self.contexts, begin = np.unique(codes >> U(16), return_index=True)
        ends = np.append(begin[1:], len(codes))
        sums = np.concatenate([[0.0], np.cumsum(self.counts)])
        self.totals, self.kinds = sums[ends] - sums[begin], (ends - begin).astype(np.float64)

    def mixed(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of each code's last character, interpolated with the shorter grams' probability lower."""
        at, there = lookup(self.codes, codes)
        own = np.where(there, np.maximum(self.counts[at] - self.discount, 0.0), 0.0) if len(self.codes) else np.zeros(len(codes))
        ctx, known = lookup(self.contexts, codes >> U(16))
        if not len(self.contexts):
            return lower
        return np.where(known, (own + self.discount * self.kinds[ctx] * lower) / self.totals[ctx], lower)


class KneserNey:
    """Interpolated model: counts at order 4, continuation counts below, uniform over the alphabet last."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet = max(alphabet, 1)
        self.levels = [Level(codes, counts)]
        for order in range(ORDER - 1, 0, -1):
            codes, counts = distinct(codes & U((1 << (16 * order)) - 1))
            self.levels.append(Level(codes, counts))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1.0 / self.alphabet)
        for order, level in zip(range(1, ORDER + 1), reversed(self.levels)):
            p = level.mixed(codes & U((1 << (16 * order)) - 1) if order < ORDER else codes, p)
        return p


class Counter:
    """Counts of codes by class in bounded memory: merged now and then, handed out when large."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.parts = limit, {}

    def add(self, kind, codes: np.ndarray) -> None:
        values, counts = distinct(codes)
        held = self.parts.setdefault(kind, [])
        held.append((values, counts))
        if len(held) > 16:
            self.parts[kind] = [self._merged(held)]

    @staticmethod
    def _merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        return distinct(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    def full(self) -> bool:
        return sum(len(v) for held in self.parts.values() for v, _ in held) > self.limit

    def drain(self) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for kind, held in self.parts.items():
            yield (kind, *self._merged(held))
        self.parts = {}
