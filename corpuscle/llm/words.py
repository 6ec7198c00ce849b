"""Words of many texts at once, as hashes and places, found and hashed in whole arrays of characters.

A word is a longest run of letters and digits (or of letters only), in lower case. A word's hash is a polynomial
over its characters modulo 2**64, read off prefix sums, so it costs a fixed number of array steps a character
and no Python object; only words whose spelling is asked for become strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import regex

MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0xD1342543DE82EF95
#: Characters that are worked on at once; a longer text is one block of its own.
BLOCK = 1 << 20
LETTER, DIGIT, SPACE, BREAK, MARK = 1, 2, 4, 8, 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned words."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


@cache
def kinds() -> np.ndarray:
    """What each code point is, as a sum of the kinds above."""
    every = "".join(map(chr, (c if not 0xD800 <= c < 0xE000 else 0 for c in range(0x110000))))
    out = np.zeros(0x110000, "u1")
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+"), (BREAK, r"[\r\n]+"), (MARK, r"[.!?]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] |= kind
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, "u8")]) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


class Scan(NamedTuple):
    """Words of a block of texts: the text each is of, its hash, and where it stands in ``joined``."""

    first: int  # number of the block's first text
    count: int
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    joined: str  # the block's texts in lower case, one after the other
    at: np.ndarray  # where each text begins in it
    kind: np.ndarray  # of each character

    def word(self, k: int) -> str:
        return self.joined[self.start[k] : self.end[k]]


def scan(texts: Sequence[str | None], digits: bool = True, block: int = BLOCK) -> Iterator[Scan]:
    """The words of all texts, in blocks of whole texts; null texts have none."""
    low, size, first = [], 0, 0
    for i, t in enumerate(texts):
        low.append(t.lower() if t else "")
        size += len(low[-1]) + 1
        if size >= block:
            yield _scan(low, first, digits)
            low, size, first = [], 0, i + 1
    if low:
        yield _scan(low, first, digits)


def _scan(low: list[str], first: int, digits: bool) -> Scan:
    joined = "\n".join(low)
    at = np.cumsum([0] + [len(t) + 1 for t in low[:-1]])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "u4")
    kind = kinds()[np.minimum(codes, 0x10FFFF)]
    inside = np.zeros(len(codes) + 2, "i1")
    inside[1:-1] = kind & (LETTER | DIGIT if digits else LETTER) != 0
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, "u8")
    np.cumsum((codes.astype("u8") + np.uint64(1)) * power[: len(codes)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] * MIX[0])
    return Scan(first, len(low), np.searchsorted(at, start, "right") - 1, h, start, end, joined, at, kind)


def run_hashes(s: Scan, k: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct runs of ``k`` words of each text with enough words, by row and hash."""
    n = np.bincount(s.row, minlength=s.count)
    if len(s.hash) < k:
        return np.empty(0, "i8"), np.empty(0, "u8")
    m = len(s.hash) - k + 1
    h = s.hash[:m].copy()
    for j in range(1, k):
        h = mix(h * MIX[0] + s.hash[j : m + j])
    h = mix(h)
    inside = (s.row[:m] == s.row[k - 1 :]) & (n[s.row[:m]] >= max(least_words, k))
    h, row = h[inside], s.row[:m][inside]
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep] + s.first, h[keep]


def sentence_words(s: Scan, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first word, past the last word)`` of each sentence: a piece of a text that ends with a mark and has
    at least so many words. Pieces end at line ends and at blanks after a mark."""
    n = len(s.joined)
    space = s.kind & SPACE != 0
    mark = s.kind & MARK != 0
    cut = s.kind & BREAK != 0
    cut[1:] |= space[1:] & mark[:-1]
    b = np.r_[np.flatnonzero(cut), n]
    a = np.r_[0, b[:-1] + 1]
    solid = np.maximum.accumulate(np.where(space, -1, np.arange(n))) if n else np.empty(0, "i8")
    last = np.where(b > 0, solid[np.maximum(b - 1, 0)], -1) if n else np.full(len(b), -1)
    ok = (last >= a) & mark[np.maximum(last, 0)] if n else np.zeros(len(b), bool)
    lo, hi = np.searchsorted(s.start, a), np.searchsorted(s.start, b)
    ok &= hi - lo >= least
    return s.row[lo[ok]] if ok.any() else np.empty(0, "i8"), lo[ok], hi[ok]
