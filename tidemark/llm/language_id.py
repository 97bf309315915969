"""Hierarchical language identification.

First the language family, by one linear model per family, then, within
it, one-versus-one linear support vector machines vote between its
languages.  Features are the hashed n-gram shares of :mod:`.ngrams` over the
whole text; all models are fitted on a bounded sample and broadcast.

``score`` is the probability of the family times the share of the winner in
the votes of its family, each vote a calibrated margin.

Cases: a null text, or one without a letter, is ``und`` with score 0; with
no labelled text every row is ``und`` with score 0, with one language all
texts get it with score 1; ties go to the smaller language code; long texts
are read whole; only the id and the text are read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import one_text
from .linear import Scaler, fit_logistic, fit_platt, fit_svm, products, sigmoid
from .ngrams import DIMS, Grams, collect_dense
from .text import slices, strings

UNKNOWN = "und"

#: Families of common language codes: fixed values.  Any other code is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sk": "slavic",
}


@dataclass
class LanguageModel:
    """Columns of ``weights``: one per family, then one per pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 0)))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a slice."""
        n = len(texts)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        z = Grams(texts).scores(self.weights, self.intercepts) * self.slopes if self.weights.shape[1] else np.zeros((n, 0))
        if len(self.families) > 1:
            odds = sigmoid(z[:, : len(self.families)]) + 1e-12
            family_p = odds / odds.sum(axis=1, keepdims=True)
        else:
            family_p = np.ones((n, 1))
        won = family_p.argmax(axis=1)
        out, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        skip = len(self.families) if len(self.families) > 1 else 0
        for f, family in enumerate(self.families):
            rows, names = np.flatnonzero(won == f), self.languages[family]
            votes = np.zeros((len(rows), len(names)))
            for k, (a, b) in enumerate(self.pairs):
                if a in names:
                    p = sigmoid(z[rows, skip + k])
                    votes[:, names.index(a)] += p
                    votes[:, names.index(b)] += 1 - p
            best = votes.argmax(axis=1)
            share = votes[np.arange(len(rows)), best] / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(rows))
            out[rows] = np.array(names, dtype=object)[best]
            score[rows] = family_p[rows, f] * share
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        out[~letters], score[~letters] = UNKNOWN, 0.0
        return out.tolist(), score


def _sample(documents: DataFrame, train: Column | None, rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most ``rows`` texts of known language in hash order of the id, one per id; ids are chosen before texts are read."""
    named = documents.select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("y")).where("key is not null and y is not null")
    if train is not None:
        named = named.where(train)
    chosen = named.groupBy("key").agg(F.min("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = documents.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return one_text(texts.join(F.broadcast(chosen), "key"))


def fit_languages(
    documents: DataFrame, train: Column | None = None, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Fit on at most ``sample_rows`` texts with a language; ``train`` is a condition on ``key``."""
    names, x = collect_dense(_sample(documents, train, sample_rows, id_col, text_col, lang_col), "y")
    langs = sorted(set(names))
    if not langs:
        return LanguageModel()
    y = np.array(names, dtype=object)
    family = np.array([FAMILY.get(v, v) for v in names], dtype=object)
    families = sorted(set(family.tolist()))
    languages = {f: sorted(set(y[family == f].tolist())) for f in families}
    columns: list[tuple[np.ndarray, float, float]] = []
    if len(families) > 1:
        scaler = Scaler(x)
        scaled = scaler.apply(x)
        for f in families:
            w, b = scaler.fold(*fit_logistic(scaled, (family == f).astype(float), l2=0.02, steps=120))
            columns.append((w, b, 1.0))
        del scaled
    pairs = [p for f in families for p in combinations(languages[f], 2)]
    for a, b in pairs:
        own = (y == a) | (y == b)
        rows = x[own]
        scaler = Scaler(rows)
        w, c = scaler.fold(*fit_svm(scaler.apply(rows), np.where(y[own] == a, 1.0, -1.0), l2=0.02, steps=120))
        slope, shift = fit_platt(products(rows, w) + c, (y[own] == a).astype(float))
        columns.append((w * slope, c * slope + shift, 1.0))
    if not columns:
        return LanguageModel(families, languages)
    weights, intercepts, slopes = zip(*columns)
    return LanguageModel(families, languages, pairs, np.stack(weights, axis=1), np.array(intercepts), np.array(slopes))


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(strings(batch.column(1))):
                names, score = shared.value.predict(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"]
                )

    kind = df.select(id_col).schema[0].dataType.simpleString()
    texts = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
