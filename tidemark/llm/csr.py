"""Sparse matrices in compressed rows, and their product row by row (Gustavson)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Csr(NamedTuple):
    """Row ``i`` has ``data[indptr[i]:indptr[i + 1]]`` in the columns ``indices`` of the same range."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each start, as many as its count, end to end."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def matrix(row: np.ndarray, column: np.ndarray, data: np.ndarray, rows: int, columns: int) -> Csr:
    """The matrix of some entries; those in one place add up."""
    place = row.astype(np.int64) * columns + column
    if len(place) and (place[1:] <= place[:-1]).any():
        order = np.argsort(place, kind="stable")
        place, data = place[order], data[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        place, data = place[first], np.add.reduceat(data, first)
    indptr = np.searchsorted(place, np.arange(rows + 1, dtype=np.int64) * columns)
    return Csr(indptr, place % columns if columns else place, data, columns)


def product(left: Csr, right: Csr) -> Csr:
    """Each row of ``left`` combines the rows of ``right`` that its entries name."""
    counts = np.diff(right.indptr)[left.indices]
    taken = ranges(right.indptr[left.indices], counts)
    data = np.repeat(left.data, counts) * right.data[taken]
    return matrix(np.repeat(left.rows, counts), right.indices[taken], data, len(left.indptr) - 1, right.columns)
