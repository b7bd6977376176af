"""Simple-8b word-aligned integer coding in numpy.

Every 64-bit word holds a 4-bit selector and 60 bits that pack as many ids as
the selector's width allows. Ids are coded in blocks of BLOCK ids; each block
starts on a word of its own, and a table of the blocks' word offsets lets a
reader decode any block alone, or all of them at once. An id of 60 bits or more
is an escape: the stream holds 0 and the id follows in an exception list.

Layout of a page (little-endian 64-bit words):
  [n ids, n blocks, n words, n escapes] [offset of each block, in words]
  [position of each escape] [id of each escape] [words]
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 1024

#: Fixed values of the coding: ids per word and bits per id, by selector 0-15.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

#: Bits of the smaller ids.
_BITS = np.searchsorted(np.left_shift(1, np.arange(17)), np.arange(1 << 16), side="right").astype(np.int8)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each position of each block (blocks x BLOCK), the selector that packs the most ids from there."""
    n, size = ids.shape
    best = np.full(ids.shape, 15, dtype=np.int8)
    # behind the block nothing follows, which any count may overrun
    widest = np.zeros((n, size + int(COUNTS[0])), dtype=np.int8)
    if ids.size and ids.max() < len(_BITS):
        widest[:, :size] = _BITS[ids]
    else:
        widest[:, :size] = np.searchsorted(np.left_shift(U64(1), np.arange(61, dtype=U64)), ids.ravel(), side="right").reshape(n, size)
    # where a selector does not fit, none of more and narrower ids does.
    span = 1  # `widest` is the bits of the widest of so many ids from each position on
    for selector in range(14, -1, -1):
        count = int(COUNTS[selector])
        while 2 * span <= count:
            widest[:, :-span] = np.maximum(widest[:, :-span], widest[:, span:])
            span *= 2
        fits = np.maximum(widest[:, :size], widest[:, count - span:count - span + size]) <= np.int8(WIDTHS[selector])
        if not fits.any():
            break
        best -= fits.view(np.int8)
    return best


def encode(ids: np.ndarray) -> bytes:
    """One page of ids (unsigned 64-bit)."""
    ids = np.asarray(ids, dtype=U64)
    total = len(ids)
    n = -(-total // BLOCK)
    escaped = np.flatnonzero(ids >= U64(1) << U64(60))
    grid = np.zeros(n * BLOCK, dtype=U64)
    grid[:total] = ids
    grid[escaped] = 0
    grid = grid.reshape(n, BLOCK)
    best = _selectors(grid)
    # walk all blocks in step, one word of each block at a time; a block that has ended stays at its last place, BLOCK
    follows = np.full((n, BLOCK + 1), BLOCK, dtype=np.int64)
    follows[:, :BLOCK] = np.arange(BLOCK) + COUNTS[best]
    follows[follows >= np.minimum(BLOCK, total - np.arange(n) * BLOCK)[:, None]] = BLOCK
    first = np.arange(n) * (BLOCK + 1)
    follows = (follows + first[:, None]).ravel()
    at, last, steps = first, first + BLOCK, []
    while (at < last).any():
        for _ in range(16):
            steps.append(at)
            at = follows[at]
    at = np.stack(steps, axis=1).ravel() if steps else np.zeros(0, np.int64)
    block, start = np.divmod(at, BLOCK + 1)
    block, start = block[start < BLOCK], start[start < BLOCK]
    chosen = best[block, start]
    words = chosen.astype(U64) << U64(60)
    padded = np.zeros((n, BLOCK + int(COUNTS[0])), dtype=U64)
    padded[:, :BLOCK] = grid
    flat, at = padded.ravel(), block * padded.shape[1] + start
    for selector in range(2, 16):
        here = np.flatnonzero(chosen == selector)
        if len(here):
            got, begin = words[here], at[here]
            for lane in range(COUNTS[selector]):
                got |= flat[begin + lane] << U64(lane * WIDTHS[selector])
            words[here] = got
    offsets = np.searchsorted(block, np.arange(n))
    head = np.array([total, n, len(words), len(escaped)], dtype=U64)
    return b"".join(x.astype("<u8").tobytes() for x in (head, offsets, escaped, ids[escaped], words))


def decode(page: bytes) -> np.ndarray:
    """All ids of a page."""
    data = np.frombuffer(page, dtype="<u8").astype(U64)
    total, n, n_words, n_escapes = (int(x) for x in data[:4])
    offsets, data = data[4:4 + n].astype(np.int64), data[4 + n:]
    where, values, words = data[:n_escapes].astype(np.int64), data[n_escapes:2 * n_escapes], data[2 * n_escapes:2 * n_escapes + n_words]
    chosen = (words >> U64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(n_words), side="right") - 1
    start = before - before[offsets][block] if n else before
    keep = np.minimum(counts, np.minimum(BLOCK, total - block * BLOCK) - start)
    start = start + block * BLOCK
    out = np.zeros(total, dtype=U64)
    for selector in range(2, 16):
        here = np.flatnonzero(chosen == selector)
        if len(here):
            lanes = np.arange(COUNTS[selector])
            got = words[here][:, None] >> (lanes * WIDTHS[selector]).astype(U64) & ((U64(1) << U64(WIDTHS[selector])) - U64(1))
            whole = keep[here] == COUNTS[selector]
            out[start[here[whole]][:, None] + lanes] = got[whole]
            if not whole.all():
                here, got = here[~whole], got[~whole]
                ok = lanes < keep[here][:, None]
                out[(start[here][:, None] + lanes)[ok]] = got[ok]
    out[where] = values
    return out
