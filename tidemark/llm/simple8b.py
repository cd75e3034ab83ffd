"""Simple-8b coding of whole numbers, packed and unpacked with numpy.

A 64-bit word holds a 4-bit selector (high bits) and as many numbers as the selector says,
the first in the lowest bits. Selectors 2 to 15 stand for 60 numbers of 1 bit down to one
of 60 bits; selector 1 stands for 120 zeros. Selector 0 is an escape: the next word is one
number of 64 bits. Numbers are coded in blocks of ``BLOCK``; a block starts with a new word,
and the list of the blocks' first words allows any block to be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128

# Fixed values of the code: numbers in a word and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, RUN = 0, 1


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each place of each block (a row) the selector that packs most numbers from there."""
    blocks, length = values.shape
    best = np.full(values.shape, 15, dtype=np.int8)
    best[values >= np.uint64(1 << 60)] = ESCAPE
    for selector in range(14, 0, -1):
        count = COUNTS[selector]
        too_wide = values >= np.uint64(1) << np.uint64(BITS[selector]) if BITS[selector] else values != 0
        # A block with fewer narrow numbers than the word would hold has no place for it; at a
        # block's end a word for fewer, wider numbers does as well.
        rows = np.flatnonzero(length - np.count_nonzero(too_wide, axis=1) >= min(count, length))
        if not len(rows):
            continue
        wide = np.zeros((len(rows), length + 1), dtype=np.int16)
        np.cumsum(too_wide[rows], axis=1, dtype=np.int16, out=wide[:, 1:])
        stop = np.minimum(np.arange(length) + count, length)
        fits = wide[:, stop] == wide[:, :length]
        best[rows] = np.where(fits, np.int8(selector), best[rows])
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words for some numbers, and the place of each block's first word."""
    values = np.asarray(values, dtype=np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    padded = np.zeros(blocks * BLOCK + COUNTS.max(), dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded[: blocks * BLOCK].reshape(blocks, BLOCK)
    selectors = _selectors(grid)
    # All blocks go forward together, one word at a time.
    place, rows, wrote = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(rows):
        selector = selectors[rows, place[rows]].astype(np.int64)
        wrote.append((rows, place[rows], selector))
        place[rows] += COUNTS[selector]
        limit = np.minimum(BLOCK, len(values) - rows * BLOCK)
        rows = rows[place[rows] < limit]
    row = np.concatenate([w[0] for w in wrote])
    at = np.concatenate([w[1] for w in wrote])
    selector = np.concatenate([w[2] for w in wrote])
    order = np.lexsort((at, row))
    row, at, selector = row[order], at[order], selector[order]
    width = 1 + (selector == ESCAPE)
    target = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), dtype=np.uint64)
    start = row * BLOCK + at
    # Numbers beyond the block are zero in its last word.
    end = (row + 1) * BLOCK
    for kind in np.unique(selector):
        here = np.flatnonzero(selector == kind)
        if kind == ESCAPE:
            words[target[here] + 1] = padded[start[here]]
            continue
        packed = np.full(len(here), np.uint64(kind) << np.uint64(60), dtype=np.uint64)
        for i in range(COUNTS[kind] if kind != RUN else 0):
            value = np.where(start[here] + i < end[here], padded[start[here] + i], np.uint64(0))
            packed |= value << np.uint64(i * BITS[kind])
        words[target[here]] = packed
    first = np.searchsorted(row, np.arange(blocks))
    return words, target[first].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` numbers that ``encode`` gave these words and offsets for."""
    out = np.zeros(len(offsets) * BLOCK + COUNTS.max(), dtype=np.uint64)
    if not count:
        return out[:0]
    escaped = np.zeros(len(words), dtype=bool)
    # A word after an escape is a raw number, even if it looks like an escape itself.
    for i in np.flatnonzero(words >> np.uint64(60) == ESCAPE):
        if not escaped[i]:
            escaped[i + 1] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.where(escaped, 0, COUNTS[selector])
    before = np.cumsum(held) - held
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    start = before - before[offsets[block]] + block * BLOCK
    end = (block + 1) * BLOCK
    for kind in range(2, 16):
        here = np.flatnonzero((selector == kind) & ~escaped)
        mask = (np.uint64(1) << np.uint64(BITS[kind])) - np.uint64(1)
        for i in range(COUNTS[kind] if len(here) else 0):
            inside = start[here] + i < end[here]
            at = here[inside]
            out[start[at] + i] = words[at] >> np.uint64(i * BITS[kind]) & mask
    raw = np.flatnonzero((selector == ESCAPE) & ~escaped)
    out[start[raw]] = words[raw + 1]
    return out[:count]
