"""Blocks of rows as numbers side by side, for fits that read them many times.

A block holds a matrix row by row: columns whose values are all small whole
numbers (one-hot ones, say) take a byte a value, the others eight.  The
numbers come back exactly as they were."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The cells of every row, one row at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield tuple(c[r].as_py() for c in batch.columns)


def matrix(x: pa.Array, n: int) -> np.ndarray:
    """Arrow lists of ``n`` doubles as a matrix."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def pack(x: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The columns that need doubles (a mask), those as doubles, the others as bytes."""
    small = ((x >= 0) & (x <= 255) & (x == np.floor(x)) & ~np.signbit(x)).all(axis=0)
    return (~small).tobytes(), np.ascontiguousarray(x[:, ~small]).tobytes(), x[:, small].astype(np.uint8).tobytes()


def unpack(mask: bytes, wide: bytes, narrow: bytes, rows: int) -> np.ndarray:
    """The matrix that :func:`pack` was given."""
    at = np.frombuffer(mask, bool)
    x = np.empty((rows, len(at)))
    x[:, at] = np.frombuffer(wide, np.float64).reshape(rows, -1)
    x[:, ~at] = np.frombuffer(narrow, np.uint8).reshape(rows, -1)
    return x
