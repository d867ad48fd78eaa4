"""Hashes of the words of many texts at once, in numpy.

Works on the UTF-8 bytes of a slice of an Arrow column. White space is U+0020 and U+0009
to U+000D, words are what stands between. A word's hash is a polynomial over random values
of its bytes, taken as a difference of running sums, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(0, 1 << 62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all of them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... in 64 bits, at least n of them."""
    known = _powers.get(which)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        known[0] = 1
        known = _powers[which] = np.multiply.accumulate(known)
    return known


@dataclass
class Words:
    data: np.ndarray  # bytes of the slice
    text_ends: np.ndarray  # offsets of the texts in data, one more than texts
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts
    sums: np.ndarray  # running sums of the byte values

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """One hash per word, of its first ``longest`` bytes if given."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        value = self.sums[end] - self.sums[self.start]
        return mix(value * _power("inverse", _INVERSE, len(self.data) + 1)[self.start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]: ends[-1]], ends - ends[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """The words of a string column."""
    data, ends = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    ink = ~_SPACE[data]
    opens = ink.copy()
    opens[1:] &= ~ink[:-1]
    closes = ink.copy()
    closes[:-1] &= ~ink[1:]
    edges = ends[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = ink[edges]  # a text's border parts words
    closes[edges - 1] = ink[edges - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power("base", _BASE, n + 1)[:n], out=sums[1:])
    return Words(data, ends, start, end, np.searchsorted(start, ends), sums)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position (n - 1 fewer than words)."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k: k + count]
    return mix(out)
