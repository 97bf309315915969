"""Hashed n-gram frequencies of texts, as one linear feature space.

Families: characters (bytes), 3-byte runs, words, word pairs and pairs of
word shapes (upper case, symbol, short, same as the word before).  A feature
is a gram's share of its family in the text, so short and long texts compare.
A linear score needs no vectors: it is a gather of weights and a sum by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import NON_BLANK, Words, hash_strings, slices, spans, strings

_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[0x61:0x7B] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[0x21, *range(0x23, 0x27), 0x2A, 0x3C, 0x3E, 0x7C]] = True  # ! # $ % & * < > |

FAMILIES = {"char": 256, "run": 2048, "word": 1024, "pair": 1024, "shape": 256}
DIMS = sum(FAMILIES.values())

#: Texts whose dense vectors are built at once.
DENSE_ROWS = 256


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


class Grams:
    """Grams of one slice of texts; ``words`` and ``ids`` are shared with other statistics."""

    def __init__(self, texts: pa.Array):
        raw, offsets = spans(texts)
        self.raw, self.offsets, self.n = raw, offsets, len(texts)
        self.words = Words(raw, offsets, NON_BLANK)
        self.ids, self.distinct = self.words.ids()

    def families(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first dimension, text of each gram, place of each gram in the family)."""
        doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.offsets))
        raw, base = self.raw, 0
        yield base, doc, raw
        base += FAMILIES["char"]
        if len(raw) >= 3:
            run = raw[:-2].astype(np.uint32) | raw[1:-1].astype(np.uint32) << 8 | raw[2:].astype(np.uint32) << 16
            inside = doc[:-2] == doc[2:]
            yield base, doc[:-2][inside], (run[inside] * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
        base += FAMILIES["run"]
        h, wdoc = hash_strings(self.distinct)[self.ids], self.words.doc
        yield base, wdoc, _bits(h, FAMILIES["word"])
        base += FAMILIES["word"]
        same = wdoc[1:] == wdoc[:-1]
        both = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        yield base, wdoc[1:][same], _bits(both[same], FAMILIES["pair"])
        base += FAMILIES["pair"]
        shape = self.shapes()
        yield base, wdoc[1:][same], (shape[:-1] * 16 + shape[1:])[same]

    def shapes(self) -> np.ndarray:
        """A 4-bit shape of each word."""
        if not len(self.words):
            return np.empty(0, np.int64)
        raw, off = spans(self.distinct)
        some = lambda table: np.add.reduceat(table[raw].astype(np.int64), off[:-1]) > 0
        kind = (some(_UPPER) & ~some(_LOWER)) * 1 + some(_SYMBOL) * 2 + (np.diff(off) <= 3) * 4
        again = np.zeros(len(self.ids), np.int64)
        again[1:] = (self.ids[1:] == self.ids[:-1]) & (self.words.doc[1:] == self.words.doc[:-1])
        return kind[self.ids] + 8 * again

    def dense(self) -> np.ndarray:
        """Share of each gram in its family, a row of ``DIMS`` per text."""
        out = np.zeros((self.n, DIMS), np.float32)
        for (base, doc, at), size in zip(self.all(), FAMILIES.values()):
            count = np.bincount(doc.astype(np.int64) * size + at, minlength=self.n * size).reshape(self.n, size)
            out[:, base : base + size] = count / np.maximum(count.sum(axis=1, keepdims=True), 1)
        return out

    def all(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``families`` with empty ones filled in."""
        got = {base: (doc, at) for base, doc, at in self.families()}
        base = 0
        for size in FAMILIES.values():
            doc, at = got.get(base, (np.empty(0, np.int64), np.empty(0, np.int64)))
            yield base, doc, at
            base += size

    def scores(self, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
        """Linear scores, a row per text and a column per model; ``weights`` is DIMS x models."""
        out = np.repeat(np.asarray(intercepts, float)[None, :], self.n, axis=0)
        for base, doc, at in self.families():
            total = np.maximum(np.bincount(doc, minlength=self.n), 1)
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(doc, weights[base:, k][at], self.n) / total
        return out


def dense_rows(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their dense feature rows."""
    for batch in batches:
        for first, part in slices(strings(batch.column(column))):
            for at in range(0, len(part), DENSE_ROWS):
                few = part.slice(at, DENSE_ROWS)
                yield batch.slice(first + at, len(few)), Grams(few).dense()


def collect_dense(sample, extra: str) -> tuple[list, np.ndarray]:
    """(values of column ``extra``, feature matrix, float16) of a bounded sample with columns ``text`` and ``extra``.

    Executors make the vectors; rows come ordered by ``key``.  The matrix stays
    as narrow as it was sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in dense_rows(batches, 0):
            vectors = pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), vectors], names=["key", "extra", "x"])

    kind = sample.select(extra).schema[0].dataType.simpleString()
    key = sample.select("key").schema[0].dataType.simpleString()
    table = sample.select("text", "key", extra).mapInArrow(run, f"key {key}, extra {kind}, x binary").toArrow()
    order = np.argsort(table["key"].to_numpy(), kind="stable") if len(table) else np.empty(0, np.int64)
    extras = table["extra"].to_pylist()
    x = np.zeros((len(table), DIMS), np.float16)
    for to, row in enumerate(order):
        x[to] = np.frombuffer(table["x"][int(row)].as_py(), np.float16)
    del table
    pa.default_memory_pool().release_unused()
    return [extras[i] for i in order], x
