"""Sketches of sets of hashes that rule out pairs which cannot be similar, and no others.

A sketch is the size of a set and a bit for each cell that it fills; the cells are ranges of
hashes, a power of two of them. Cells that only one of two sets fills tell how many hashes
at least are in it alone.
"""

from __future__ import annotations

import numpy as np


def sketch(tokens: np.ndarray, per_hash: int) -> bytes:
    """The sketch of a set with at least ``per_hash`` cells for each of its hashes."""
    cells = 64
    while cells < per_hash * len(tokens):
        cells *= 2
    filled = np.zeros(cells, dtype=bool)
    filled[(tokens >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)] = True
    return len(tokens).to_bytes(4, "little") + np.packbits(filled).tobytes()


def _halved(bits: np.ndarray) -> np.ndarray:
    pairs = bits | bits << 1  # the left one of each two cells is filled if one of them is
    packed = np.zeros_like(bits)
    for i in range(4):
        packed |= ((pairs >> (7 - 2 * i)) & 1) << (7 - i)
    return packed[..., 0::2] | packed[..., 1::2] >> 4


class Sketches:
    """Some sketches as arrays, by their number of cells; ``similarity`` in hundredths of the union, 51 at least."""

    def __init__(self, sketches: list[bytes], similarity: int):
        self.similarity = similarity
        self.size = np.array([int.from_bytes(s[:4], "little") for s in sketches], dtype=np.int64)
        self.width = np.array([len(s) - 4 for s in sketches], dtype=np.int64)
        self.place = np.zeros(len(sketches), dtype=np.int64)
        self.bits: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            joined = b"".join([sketches[i][4:] for i in at.tolist()])
            self.bits[width] = np.frombuffer(joined, np.uint8).reshape(len(at), width)

    def linkable(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that the one at ``i`` could be similar to."""
        size, width = self.size[i], int(self.width[i])
        low, high = np.minimum(self.size[others], size), np.maximum(self.size[others], size)
        others = others[100 * low >= self.similarity * high]
        own = self.bits[width][self.place[i]]
        found = []
        # Sizes that fit differ by less than two, so cells by one halving at most.
        for of in (width // 2, width, 2 * width):
            some = others[self.width[others] == of]
            if len(some):
                x, y = own, self.bits[of][self.place[some]]
                if of > width:
                    y = self._fewer(y)
                elif of < width:
                    x = self._fewer(x)
                found.append(some[self._allowed(x, size, y, self.size[some])])
        return np.concatenate(found) if found else others[:0]

    @staticmethod
    def _fewer(cells: np.ndarray) -> np.ndarray:
        """Sketches with half as many cells: neighbours become one."""
        return _halved(cells)

    def matches(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A sketch tells no more than ``linkable`` has looked at."""
        return np.ones(len(left), dtype=bool)

    def _allowed(self, x: np.ndarray, x_size, y: np.ndarray, y_size) -> np.ndarray:
        if x.shape[-1] % 8 == 0:
            x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)
        x_only = np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64)
        y_only = np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64)
        both = np.minimum(x_size - x_only, y_size - y_only)
        return 100 * both >= self.similarity * (x_size + y_size - both)


def counting_sketch(tokens: np.ndarray) -> bytes:
    """The size of a set, and how many of its hashes are in each cell, up to 3: 1 to 2 bits for each hash."""
    cells = 64
    while 2 * cells < len(tokens):
        cells *= 2
    place = (tokens >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=cells), 3).astype(np.uint8)
    packed = counts[0::4] | counts[1::4] << 2 | counts[2::4] << 4 | counts[3::4] << 6
    return len(tokens).to_bytes(4, "little") + packed.tobytes()


class CountingSketches(Sketches):
    """The same for counting sketches: what is over in a cell of one set is not in the other."""

    def __init__(self, sketches: list[bytes], similarity: int):
        super().__init__(sketches, similarity)
        self.bits = {4 * width: self._counts(packed) for width, packed in self.bits.items()}
        self.width = 4 * self.width

    @staticmethod
    def _counts(packed: np.ndarray) -> np.ndarray:
        found = np.stack([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=2)
        return found.reshape(len(packed), -1).astype(np.int8)

    @staticmethod
    def _fewer(cells: np.ndarray) -> np.ndarray:
        return np.minimum(cells[..., 0::2] + cells[..., 1::2], 3)

    def _allowed(self, x: np.ndarray, x_size, y: np.ndarray, y_size) -> np.ndarray:
        over = np.maximum(x - y, 0).sum(axis=-1, dtype=np.int64)
        under = np.maximum(y - x, 0).sum(axis=-1, dtype=np.int64)
        both = np.minimum(x_size - over, y_size - under)
        return 100 * both >= self.similarity * (x_size + y_size - both)
