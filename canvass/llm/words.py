"""Numpy kernels over Arrow text batches: word bounds, 64-bit word hashes, shingles.

Texts stay UTF-8 bytes. The separators of every contract are ASCII, so byte
classes decide the words, and code points are counted by non-continuation bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random64(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) + U64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=U64))


#: Value of each byte in the polynomial word hash, and its multiplier.
BYTE_VALUE = random64(11, 256)
MULTIPLIER = U64(0x9E6C63D0876A9A47)
_POWERS = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """MULTIPLIER ** 0..n-1 modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 4096), MULTIPLIER, dtype=U64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=U64)
    return _POWERS[:n]


#: `[^\x20\x09-\x0D]+`: every byte but the six blanks.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text: digits, a-z and all non-ASCII bytes.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 bounds of its texts; null is the empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
    """Start and end byte of every word, and the n + 1 word bounds of the texts."""
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = first[1:] - 1
    if len(first):
        ends[last] = inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word [begin, end)."""
    if not len(begin):
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        size = end - begin
        where = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        value = BYTE_VALUE[data[where]] * powers(int(size.max()))[where - np.repeat(begin, size)]
        sums = np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1])))
        return mix(sums + size.astype(U64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (over text bounds, too: mask with `inside`)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=U64)
        for j, power in enumerate(powers(k)):
            out += hashes[j:j + n] * power
        return mix(out + U64(k))


def doc_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one text; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return np.zeros(0, dtype=U64)
    return np.unique(windows(hashes, min(k, len(hashes))))


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (length + 1 values)."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
