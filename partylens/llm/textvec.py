"""Whole-array text primitives: many texts become one array of code points, words become hashes.

All functions are vectorised over a run of texts, so the cost a word is a few array passes.
Hashes are polynomials modulo 2**64 over lower-cased code points, mixed at the end; they depend on
the text alone, never on its place or on the process.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
_LIMIT = 0x20000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point; beyond the first two planes all are letters without case."""
    kind, lower = np.full(_LIMIT + 1, LETTER, np.uint8), np.arange(_LIMIT + 1, dtype=np.uint32)
    # left out: ideographs, Hangul, private use and historic scripts, letters without case
    for cp in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D000, 0x1FC00)):
        c = chr(cp)
        category = unicodedata.category(c)[0]
        kind[cp] = SPACE if c.isspace() else {"L": LETTER, "N": NUMBER, "M": MARK}.get(category, OTHER)
        low = c.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
    return kind, lower


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                _powers[k] = np.multiply.accumulate(values)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Codes:
    points: np.ndarray  # code points, a line feed after each text
    offsets: np.ndarray  # where each text starts; one more at the end
    kind: np.ndarray
    lower: np.ndarray


def codes(texts: list[str]) -> Codes:
    kind, lower = tables()
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    if points.size and points.max() >= _LIMIT:
        near = np.minimum(points, _LIMIT)
        low = lower[near]
        return Codes(points, offsets, kind[near], np.where(points >= _LIMIT, points, low))
    return Codes(points, offsets, kind[points], lower[points])


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed hash of values[start:end] for each span (not empty)."""
    forward, back = powers(len(values))
    with np.errstate(over="ignore"):
        total = np.cumsum((values.astype(np.uint64) + np.uint64(1)) * forward)
        h = total[end - 1]
        inner = start > 0
        h[inner] -= total[start[inner] - 1]
        return mix(h * back[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    hash: np.ndarray  # of the lower-cased word
    start: np.ndarray  # in Codes.points
    end: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i + 1]


def words(c: Codes) -> Words:
    """Maximal runs of letters, marks and numbers."""
    inside = np.zeros(len(c.kind) + 2, np.int8)
    inside[1:-1] = (c.kind == LETTER) | (c.kind == NUMBER) | (c.kind == MARK)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = span_hashes(c.lower, start, end) if len(start) else np.zeros(0, np.uint64)
    return Words(h, start, end, np.searchsorted(start, c.offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the bounds a text; a text of fewer words is one shingle of all it has."""
    n, with_error = len(w.hash), np.errstate(over="ignore")
    lengths = np.diff(w.bounds)
    with with_error:
        h = w.hash.copy()
        for j in range(1, k):
            h[: n - j] = h[: n - j] * np.uint64(0x100000001B3) + w.hash[j:] if n > j else h[: n - j]
        h = mix(h)
    keep = np.ones(n, bool)
    for i in np.flatnonzero(lengths > 0):
        a, b = w.bounds[i], w.bounds[i + 1]
        if b - a >= k:
            keep[b - k + 1 : b] = False
        else:
            value = w.hash[a]
            with np.errstate(over="ignore"):
                for x in w.hash[a + 1 : b]:
                    value = value * np.uint64(0x100000001B3) + x
            h[a] = mix(np.array([value], np.uint64))[0]
            keep[a + 1 : b] = False
    bounds = np.concatenate([[0], np.cumsum(keep)])[w.bounds]
    return h[keep], bounds
