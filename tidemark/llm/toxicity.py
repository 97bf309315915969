"""Toxicity by weak supervision.

1. Voters.  Each fires on a lexicon word, or on a pattern (words with a given
   start: one, two or three different ones).  Seed words are fixed; the rest
   are the terms whose presence goes with the label on a bounded sample of
   labelled rows (likelihood ratio and precision).
2. Label model.  Every document of the corpus votes; Spark sums the votes and
   the pairs of votes (a table of at most voters squared).  Pairs that agree
   more than a common cause explains are correlated and form clusters, which
   vote once.  Accuracies follow in closed form from the covariances of three
   voters of different clusters; voters without such a triple take theirs
   from the labelled counts.  Bayes' rule turns the votes of a text into a
   posterior.
3. Classifier.  A linear classifier on the terms of a text is trained on the
   posteriors of the sample, calibrated on its labels, and scores every whole
   text in Arrow batches.

Cases: null and empty texts have no term and get the smallest score, the
intercept's; with no labelled row the seed words vote alone with assumed
accuracies; with a single label value no term is mined; texts are read whole
and a term counts once a text, so repeats don't matter; equal texts get equal
scores; an empty table gives an empty result; only the id and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_texts
from .linear import fit_logistic, fit_platt, products, sigmoid

#: Seed lexicon: fixed values.
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "vermin", "filth"]

_WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6, 7)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(text: str) -> set[str]:
    """Words of a text, and ``start*``, ``start*2``, ``start*3`` for one, two or three different longer words."""
    words = words_of(text)
    starts = Counter(w[:k] for w in words for k in STARTS if len(w) > k)
    out = set(words)
    for s, n in starts.items():
        out.update((f"{s}*", f"{s}*2", f"{s}*3")[: min(n, 3)])
    return out


class TermIndex:
    """Finds known terms; remembers what each word can match."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = {t: i for i, t in enumerate(terms) if "*" not in t}
        self.starts: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(terms):
            if "*" in t:
                start, times = t.split("*")
                self.starts.setdefault(start, []).append((int(times or 1), i))

    def find(self, text: str) -> list[int]:
        """Places of the terms of a text, sorted."""
        out: list[int] = []
        count: dict[str, int] = {}
        known, starts = self.words, self.starts
        for w in words_of(text):
            if w in known:
                out.append(known[w])
            if len(w) > 4 and w[:4] in self.stems:
                for k in STARTS:
                    if len(w) > k and (s := w[:k]) in starts:
                        count[s] = count.get(s, 0) + 1
        for s, n in count.items():
            out.extend(i for times, i in starts[s] if n >= times)
        return sorted(out)

    @property
    def stems(self) -> set[str]:
        """The first four characters of every known start."""
        if not hasattr(self, "_stems"):
            self._stems = {s[:4] for s in self.starts}
        return self._stems


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    intercept: float
    a: float = 1.0
    b: float = 0.0
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)
    clusters: list[list[str]] = field(default_factory=list)

    def scores(self, texts: list[str | None], index: TermIndex) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        for i, t in enumerate(texts):
            if t:
                found = index.find(t)
                if found:
                    z[i] += self.weights[found].sum()
        return sigmoid(self.a * z + self.b)


def _mine(sample: DataFrame, n_pos: int, n_neg: int, limit: int, least: int, strength: float, precision: float) -> list[tuple[str, int, int]]:
    """(term, toxic texts, other texts) of the ``limit`` terms that go with the label most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = list(terms_of(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32())], names=["term", "y"])

    counts = sample.select("y", "text").mapInArrow(run, "term string, y int").groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    n, both = F.col("p") + F.col("q"), n_pos + n_neg
    part = lambda x, total: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * both / (n * total))).otherwise(0.0)
    best = (
        counts.where((F.col("p") >= least) & (F.col("p") >= precision * n))
        .withColumn("g", 2 * (part("p", n_pos) + part("q", n_neg))).where(F.col("g") >= strength)
        .orderBy(F.desc("g"), "term").limit(limit)
    )
    return [(r.term, r.p, r.q) for r in best.collect()]


def vote_moments(df: DataFrame, voters: list[str], text_col: str = "text") -> tuple[int, np.ndarray]:
    """(texts, matrix of the number of texts in which both voters fire) over all rows.

    A task sums its own texts, so it sends one small matrix whatever it reads.
    """
    shared = df.sparkSession.sparkContext.broadcast(TermIndex(voters))
    m = len(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = 0, np.zeros((m, m), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                found = shared.value.find(text) if text else []
                if found:
                    pairs[np.ix_(found, found)] += 1
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, i], pa.int32()), pa.array(np.r_[-1, j], pa.int32()), pa.array(np.r_[total, pairs[i, j]], pa.int64())], names=["i", "j", "n"]
        )

    sums = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros((m, m)), 0
    for r in sums:
        if r.i < 0:
            total = r.n
        else:
            out[r.i, r.j] = r.n
    return int(total), out


def fit_label_model(
    total: int, pairs: np.ndarray, prior: float, anchors: np.ndarray, correlated: float = 0.3
) -> tuple[np.ndarray, list[list[int]]]:
    """(P(fires | toxic), P(fires | clean)) of each voter, and clusters of correlated voters.

    ``anchors`` has the same two probabilities from labelled counts.  For
    voters i, j, k that are independent given the label the covariances obey
    ``c_ij * c_ik / c_jk = a_i ** 2`` with ``a_i = sqrt(prior * (1 - prior)) *
    (P(fires | toxic) - P(fires | clean))``.
    """
    m = len(pairs)
    if m == 0 or total == 0:
        return anchors.copy(), [[i] for i in range(m)]
    p = np.diag(pairs) / total
    cov = pairs / total - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    # What the anchors' accuracies explain; the rest is direct dependence.
    unit = np.sqrt(max(prior * (1 - prior), 1e-9))
    a0 = unit * (anchors[:, 0] - anchors[:, 1])
    rest = (cov - np.outer(a0, a0)) / np.outer(spread, spread)
    label = np.arange(m)
    for i in range(m):
        for j in range(i):
            if rest[i, j] > correlated and label[i] != label[j]:
                label[label == label[i]] = label[j]
    clusters = [np.flatnonzero(label == c).tolist() for c in sorted(set(label.tolist()))]
    out = anchors.copy()
    noise = 3.0 / np.sqrt(total)
    for i in range(m):
        corr = cov / np.outer(spread, spread)
        # Partners whose covariance with i stands clear of chance, one a cluster.
        far = [max((j for j in c), key=lambda j: corr[i, j]) for c in clusters if i not in c]
        far = [j for j in far if corr[i, j] > noise]
        found = [cov[i, j] * cov[i, k] / cov[j, k] for x, j in enumerate(far) for k in far[:x] if corr[j, k] > noise]
        if len(found) >= 3:
            d = np.sqrt(max(float(np.median(found)), 0.0)) / unit
            hit, false = p[i] + (1 - prior) * d, p[i] - prior * d
            if 0 < hit < 1 and false >= 0:
                out[i] = hit, false
    return np.clip(out, 1e-4, 1 - 1e-4), clusters


def posterior(found: list[int], accuracies: np.ndarray, clusters: list[list[int]], prior: float) -> float:
    """P(toxic | votes): independent clusters, each speaking through its strongest voter that fired."""
    z = np.log(prior / (1 - prior))
    fired = set(found)
    for c in clusters:
        own = [i for i in c if i in fired]
        if own:
            z += max(np.log(accuracies[i, 0] / accuracies[i, 1]) for i in own)
        else:
            z += min(0.0, max(np.log((1 - accuracies[i, 0]) / (1 - accuracies[i, 1])) for i in c))
    return float(sigmoid(np.array(z)))


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    sample_rows: int = 8000,
    max_voters: int = 96,
    max_terms: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows and on the votes of all documents."""
    sample = labelled_texts(documents, labels, "toxic", train, sample_rows, id_col, text_col)
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    mined = _mine(sample, n_pos, n_neg, max_terms, 4, 12.0, 0.6) if n_pos and n_neg else []
    seen = {t for t, _, _ in mined}
    terms = mined + [(s, 0, 0) for s in SEEDS if s not in seen]
    # Strong terms vote; all terms are features.  An unseen seed is trusted like a strong one.
    voters = terms[:max_voters] + [t for t in terms[max_voters:] if t[0] in SEEDS]
    prior = min(max((n_pos + 1) / (n_pos + n_neg + 2), 0.01), 0.99) if n_pos + n_neg else 0.1
    anchors = np.array([((p + 0.5) / (n_pos + 1), (q + 0.5) / (n_neg + 1)) if p + q else (0.2, 0.002) for _, p, q in voters])
    names = [t for t, _, _ in voters]
    total, pairs = vote_moments(documents, names, text_col)
    accuracies, clusters = fit_label_model(total, pairs, prior, anchors)

    # Term places and votes of the sample: short integer lists, not texts.
    shared = documents.sparkSession.sparkContext.broadcast(TermIndex([t for t, _, _ in terms]))
    place = {t: i for i, (t, _, _) in enumerate(terms)}
    voter_of = {place[t]: v for v, t in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.find(t) if t else [] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["key", "y", "found"])

    key = sample.select("key").schema[0].dataType.simpleString()
    rows = sample.select("key", "y", "text").mapInArrow(run, f"key {key}, y int, found array<int>").collect()
    rows = sorted(rows, key=lambda r: (r.key, r.found, r.y))
    model = ToxicityModel([t for t, _, _ in terms], np.zeros(len(terms)), float(np.log(prior / (1 - prior))))
    model.accuracies = {t: tuple(accuracies[v]) for v, t in enumerate(names)}
    model.clusters = [[names[i] for i in c] for c in clusters]
    if not rows:  # nothing to train on: the voters' evidence is the classifier
        for v, t in enumerate(names):
            model.weights[place[t]] = np.log(accuracies[v, 0] / accuracies[v, 1])
        return model
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        x[i, r.found] = 1.0
    soft = np.array([posterior([voter_of[f] for f in r.found if f in voter_of], accuracies, clusters, prior) for r in rows])
    w, c = fit_logistic(x, soft, l2=1e-3, steps=400)
    # A seed no sampled text holds keeps the evidence of its vote.
    unseen = x.sum(axis=0) == 0
    for v, t in enumerate(names):
        if unseen[place[t]]:
            w[place[t]] = np.log(accuracies[v, 0] / accuracies[v, 1])
    y = np.array([r.y for r in rows], float)
    a, b = fit_platt(products(x, w) + c, y) if n_pos and n_neg else (1.0, 0.0)
    model.weights, model.intercept = w, c
    model.a, model.b = (a, b) if a > 0 else (1.0, 0.0)
    return model


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, P(toxic), of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast((model, TermIndex(model.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = shared.value
        for batch in batches:
            got = own.scores(batch.column(1).to_pylist(), index)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(df: DataFrame, model: ToxicityModel, reject_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with a score below ``reject_at``."""
    shared = df.sparkSession.sparkContext.broadcast((model, TermIndex(model.terms)))

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        own, index = shared.value
        return pa.array(own.scores(texts.to_pylist(), index), pa.float64())

    return df.where(toxic(F.col(text_col).cast("string")) < reject_at)
