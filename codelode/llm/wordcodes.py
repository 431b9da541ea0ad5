"""Words and shingles of texts as 64-bit codes, vectorised over bytes.

Words are the runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. Equal words have equal codes; different words share one with a chance near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U)
_MULT = _RNG.integers(0, 2**64, 64, dtype=U) | U(1)
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every bit of x over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, _CHUNK + 1), base, dtype=U)
        got[0] = 1
        got = np.cumprod(got, dtype=U)
        if len(got) <= 8 * _CHUNK:
            _powers[int(base)] = got
    return got[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends (exclusive) of the words of a uint8 array."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Code of each span; works in chunks of whole words, so memory follows the chunk and not the text."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        part = data[base : ends[j - 1]]
        values = _BYTE[_LOWER[part] if lower else part] * _power(_P, len(part))
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(values, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        code = (sums[b] - sums[a]) * _power(_P_INV, len(part) + 1)[a]
        out[i:j] = mix(code + (b - a).astype(U) * _MULT[63])
        i = j
    return out


def text_batches(texts: list[str | None], limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about limit bytes: first and last index, the bytes joined by line feeds, each text's byte start."""
    first, parts, total = 0, [], 0
    for i, t in enumerate(texts):
        parts.append((t or "").encode("utf-8", "surrogatepass"))
        total += len(parts[-1]) + 1
        if total >= limit or i + 1 == len(texts):
            starts = np.zeros(len(parts) + 1, dtype=np.int64)
            np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
            yield first, i + 1, np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8), starts
            first, parts, total = i + 1, [], 0


def batch_words(data: np.ndarray, text_starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, byte starts and byte ends of all words of a run, and each text's first word (one more at the end)."""
    starts, ends = word_spans(data)
    return word_codes(data, starts, ends, lower), starts, ends, np.searchsorted(starts, text_starts)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-word sequences; sequences run across texts where codes do, callers cut there."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=U)
    total = np.zeros(size, dtype=U)
    for k in range(n):
        total += codes[k : k + size] * _MULT[k]
    return mix(total)


def shingle_set(codes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct codes of a text's n-word shingles; fewer words make one shingle, none an empty set."""
    if len(codes) >= n:
        return np.unique(grams(codes, n))
    if len(codes) == 0:
        return np.empty(0, dtype=U)
    return mix(grams(codes, len(codes)) + U(len(codes)))
