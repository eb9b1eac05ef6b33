"""Words of many texts at once, as 64-bit hashes with document and position (numpy).

A word class is a table of 256 byte flags. Both classes in use treat every code point above
U+007F as a word character, and all bytes of such a code point in UTF-8 are above 0x7F, so
splitting bytes splits the same words as a regular expression over code points.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# fixed values: [^\x20\x09-\x0D]+ and, after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(SPACE_BYTES)] = False
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**64, 256, dtype=np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _to_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers


class Words(NamedTuple):
    hash: np.ndarray        # uint64, one per word
    doc: np.ndarray         # ordinal of the text in the slice
    start: np.ndarray       # byte range in the slice
    end: np.ndarray
    first: np.ndarray       # per text: index of its first word; one more entry at the end


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``, A-Z lower-cased before hashing.

    Each hash is a polynomial over random byte values, taken from prefix sums and mixed; it
    depends on the word's bytes alone.
    """
    text = LOWER[data[offsets[0]:offsets[-1]]]
    at = offsets - offsets[0]
    inside = word_byte[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(text))]     # where one text meets the next
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _to_power(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[text] * power[:len(text)], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start])
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(hashed, doc, start, end, first)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive entries (across texts; callers select)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j:len(h) - n + 1 + j] * np.uint64(pow(BASE, 2 * j + 1, 2**64))
    return mix(out)


def run_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash per run ``h[first[i]:end[i]]``, of its entries and their order."""
    power, inverse = _to_power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:len(h)], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
