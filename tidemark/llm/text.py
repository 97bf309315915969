"""Flat-array text helpers shared by the corpus operators.

A slice of an Arrow string column is treated as one byte array.  Word
boundaries depend on ASCII bytes only, so they are found on UTF-8 bytes
without decoding: every byte from 0x80 up belongs to a word.  All helpers
are exact for any valid text, null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; bounds the numpy temporaries.
SLICE_BYTES = 2 << 20

#: Word bytes: everything but blank and 0x09-0x0D.
NON_BLANK = np.ones(256, dtype=bool)
NON_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes: ASCII digits and letters, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with 32-bit offsets and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) with about ``limit`` bytes each; one long text stays whole."""
    _, offsets = spans(texts)
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, texts.slice(first, last - first)
        first = last


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw + 32, raw).astype(np.uint8)


class Words:
    """Words of a slice of texts, as runs of ``table`` bytes.

    ``start``/``end`` are byte positions in ``raw``; words of text i are
    ``first[i]:first[i + 1]``; ``doc`` has the text of each word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.raw, self.offsets, self.mask = raw, offsets, table[raw]
        n = len(raw)
        begins = self.mask.copy()
        begins[1:] &= ~self.mask[:-1]
        firsts = offsets[:-1][offsets[:-1] < n]
        begins[firsts] = self.mask[firsts]
        ends = self.mask.copy()
        ends[:-1] &= ~self.mask[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        ends[lasts] = self.mask[lasts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def arrow(self) -> pa.Array:
        """The words as one binary array."""
        return binary(self.raw[self.mask], self.end - self.start)

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """(id of each word, distinct words): equal words have equal ids."""
        coded = self.arrow().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; distinct words are hashed once."""
        ids, distinct = self.ids()
        return hash_strings(distinct)[ids]


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array from joined bytes and lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64 finaliser), wrap-around arithmetic."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit polynomial hashes of a binary array, the same in every process.

    A prefix sum of byte codes times powers gives every value at once; the
    start's power is divided out with the inverse of the odd base.
    """
    if len(values) == 0:
        return np.empty(0, np.uint64)
    raw, offsets = spans(values)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(len(raw)), out=total[1:], dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    steps = np.full(len(raw) + 1, inverse, np.uint64)
    steps[0] = 1
    undo = np.cumprod(steps, dtype=np.uint64)
    h = (total[offsets[1:]] - total[offsets[:-1]]) * undo[offsets[:-1]]
    return mix(h + (np.diff(offsets).astype(np.uint64) << np.uint64(32)))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling k-word hashes: (hash, index of the first word), none across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= last[:n])
    return mix(h[at]), at

