"""Quality rules: fixed base rules and a calibrated n-gram logistic regression.

The model is fitted on at most ``sample_rows`` labelled documents (hash order
of the id): weights on four fifths of them, a Platt calibration on the rest.
It is broadcast (40 kB) and scored in Arrow batches against fixed thresholds.

Cases: a null or empty text has no words and fails the base rules; texts of
any length are read whole; equal texts get equal verdicts; with no labelled
document, or only one label value, the model's verdict is true for all rows
and the base rules decide alone; an empty table gives an empty result; only
the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts
from .linear import Scaler, fit_logistic, fit_platt, products, sigmoid
from .ngrams import DIMS, Grams, collect_dense
from .text import binary, slices, strings

#: Characters counted as symbols: fixed values.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = 0x0A


@dataclass
class Rules:
    """Thresholds: fewest words, largest share of repeated words, smallest probability of good quality."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    min_quality: float = 0.5


@dataclass
class QualityModel:
    weights: np.ndarray  # DIMS x 1
    intercept: float
    a: float
    b: float

    def probability(self, grams: Grams) -> np.ndarray:
        return sigmoid(self.a * grams.scores(self.weights, np.array([self.intercept]))[:, 0] + self.b)


def fit_quality(
    documents: DataFrame, labels: DataFrame, train: Column | None = None, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text"
) -> QualityModel:
    """The calibrated model of P(quality = 1); ``train`` is a condition on ``key``."""
    sample = labelled_texts(documents, labels, "quality", train, sample_rows, id_col, text_col)
    y, x = collect_dense(sample, "y")
    y = np.array(y, float)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros((DIMS, 1)), 0.0, 0.0, 50.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    own = held if held.any() else ~held
    train, rest = x[~held], x[own]
    del x
    scaler = Scaler(train)
    scaled = scaler.apply(train)
    del train
    w, c = scaler.fold(*fit_logistic(scaled, y[~held], l2=0.05))
    a, b = fit_platt(products(rest, w) + c, y[own])
    return QualityModel(w.reshape(-1, 1), c, a, b)


def base_statistics(grams: Grams) -> dict[str, np.ndarray]:
    """Word count, code points in words, symbols, repeated lines and words in repeated 3-word windows."""
    words, n, raw, offsets = grams.words, grams.n, grams.raw, grams.offsets
    in_text = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    return {
        "n_words": np.diff(words.first),
        "word_chars": in_text(words.mask & ((raw & 0xC0) != 0x80)),
        "n_symbols": in_text(_SYMBOL[raw]),
        "n_dup_lines": _repeated_lines(raw, offsets, words.mask),
        "n_repeat_words": _repeated_words(grams.ids, words.doc, n),
    }


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n, size = len(offsets) - 1, len(raw)
    breaks = np.flatnonzero(raw == _NEWLINE)
    start = np.unique(np.r_[offsets[:-1][offsets[:-1] < size], breaks + 1])
    start = start[start < size]
    if not len(start):
        return np.zeros(n, np.int64)
    # Without its line break a line ends where the next begins, or one byte before.
    end = np.r_[start[1:], size]
    end = end - ((raw[end - 1] == _NEWLINE) & (end > start))
    seen = np.r_[0, np.cumsum(mask)]
    real = seen[end] > seen[start]
    start, end = start[real], end[real]
    if not len(start):
        return np.zeros(n, np.int64)
    inside = np.zeros(size + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    lines = binary(raw[np.cumsum(inside[:-1]) > 0], end - start).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc = np.searchsorted(offsets, start, side="right") - 1
    key = doc.astype(np.int64) << 32 | lines
    by = np.argsort(key, kind="stable")
    again = key[by][1:] == key[by][:-1]
    return np.bincount(doc[by][1:][again], minlength=n)


def _repeated_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in 3-word windows that their text holds twice or more, the first one included."""
    if len(ids) < 3:
        return np.zeros(n, np.int64)
    top = int(ids.max()) + 1
    pairs = ids[:-1] * top + ids[1:]
    if top >= 1 << 20:  # three ids no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    at = np.flatnonzero(doc[2:] == doc[:-2])
    window = (pairs[:-1] * top + ids[2:])[at]
    by = np.argsort(window, kind="stable")  # equal windows of a text are neighbours
    same = (window[by][1:] == window[by][:-1]) & (doc[at[by]][1:] == doc[at[by]][:-1])
    often = np.r_[at[by][1:][same], at[by][:-1][same]]
    marked = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        marked[often + k] = True
    return np.bincount(doc[marked], minlength=n)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(texts: pa.Array, model: QualityModel, rules: Rules) -> dict[str, np.ndarray]:
    """Statistics, probability and verdicts of a slice of texts."""
    grams = Grams(texts)
    out = base_statistics(grams)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (out["n_repeat_words"] > rules.max_repeat_share * out["n_words"])
    out["quality"] = model.probability(grams)
    out["kept"] = ~out["base_failed"] & (out["quality"] >= rules.min_quality)
    return out


def apply_rules(df: DataFrame, model: QualityModel, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the statistics, base_failed, quality (probability of label 1) and kept, per row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [*STATS, "base_failed", "quality", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(1))):
                got = judge(part, shared.value, rules)
                cols = [pa.array(got[c], pa.int64() if c in STATS else None) for c in names]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), *cols], names=[id_col, *names])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} bigint" for c in STATS), "base_failed boolean", "quality double", "kept boolean"])
    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(df: DataFrame, model: QualityModel, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text passes."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = [judge(part, shared.value, rules)["kept"] for _, part in slices(strings(texts))]
        return pa.array(np.concatenate(parts) if parts else np.empty(0, bool))

    return df.where(good(F.col(text_col).cast("string")))

