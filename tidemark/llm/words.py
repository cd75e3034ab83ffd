"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a maximal run of bytes other than space and the five ASCII controls
0x09-0x0D, which is the same as ``[^\\x20\\x09-\\x0D]+`` on the text, because no byte of a
longer UTF-8 character is in that range. Nulls have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one numpy pass works on, unless a single text is longer. It bounds
#: the memory of a task; results do not depend on it.
CHUNK_BYTES = 4 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about ``limit`` bytes each."""
    lengths = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = lengths[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, end to end, and the offsets of its rows; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct_pieces(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each piece of bytes that stand end to end its number among the distinct ones, and these."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), buffers).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Words:
    """The words of some texts: ``starts``, ``ends`` in ``data``; ``bounds`` gives each text's range."""

    def __init__(self, texts: pa.Array, fold_ascii: bool = False):
        self.data, self.offsets = utf8(texts)
        if fold_ascii:
            upper = (self.data >= 0x41) & (self.data <= 0x5A)
            self.data = self.data + upper.astype(np.uint8) * np.uint8(32)
        word = ~SEPARATOR[self.data]
        self.in_word = word
        edge = np.zeros(len(word) + 1, dtype=bool)
        edge[self.offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """For each word its number in a list of the distinct words, and that list (as bytes)."""
        return distinct_pieces(self.data[self.in_word], self.ends - self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        numbers, distinct = self.encoded()
        digest = xxhash.xxh3_64_intdigest
        names = np.fromiter((digest(word) for word in distinct.to_pylist()), np.uint64, len(distinct))
        return names[numbers] if len(numbers) else np.zeros(0, dtype=np.uint64)


def mix(value: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    value = value ^ (value >> np.uint64(30))
    value *= MIX_1
    value ^= value >> np.uint64(27)
    value *= MIX_2
    value ^= value >> np.uint64(31)
    return value


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring windows from their own hashes."""
    return mix(left * MULTIPLIER + right)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words, made by doubling; the last words start none.

    Windows are taken across the whole array; the caller leaves out those that cross texts.
    """
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64)
    power, size, whole, done = hashes, 1, None, 0
    while True:
        if length & size:
            if whole is None:
                whole, done = power, size
            else:
                count = len(hashes) - done - size + 1
                whole, done = joined(whole[:count], power[done : done + count]), done + size
        if 2 * size > length:
            return whole[: len(hashes) - length + 1]
        power, size = joined(power[:-size], power[size:]), 2 * size


def inside(counts: np.ndarray, length: int) -> np.ndarray:
    """Which positions of all texts' words start a window of ``length`` that stays in its text."""
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    total = int(bounds[-1])
    room = np.repeat(bounds[1:], counts) - np.arange(total)
    return room >= length
