"""Exact additive attribution of tree models, compiled from their paths.

A leaf pays its value when the conditions of its path hold.  With S the known
features, a condition on an unknown one counts by the share of the fit rows
that took that branch, so the worth of S at a leaf is value * product of the
tests (0 or 1) over S * product of the branch shares over the rest.  The
Shapley values of that product depend on a row through its tests only: with m
features on a path there are 2^m outcomes, whose values are worked out here
once per leaf.  A row then finds, per leaf, the number of its outcome and reads
its values from a constant array: built-in expressions, no shuffle, no Python
in tasks.  A row's attributions and the base add up to its raw score.

Bound: the constants of a model, the sum of m * 2^m over its leaves, are at
most ``MAX_CONSTANTS``; deeper models raise.  Their number depends on the model
alone, never on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Constants that the expressions of one model may hold.
MAX_CONSTANTS = 200_000


class Leaf(NamedTuple):
    """Value, and per feature of the path (feature, tests as SQL on ``__x``, branch share)."""

    value: float
    path: list[tuple[int, list[str], float]]


def model_leaves(tree_model) -> list[Leaf]:
    """All leaves of a fitted Spark ML tree, forest or boosted model, values
    times their tree's weight.  A forest's value is the share of the positive
    class, as its probability; a boosted model's is its raw score."""
    java = tree_model._java_obj
    single = not hasattr(tree_model, "trees")
    trees, weights = ([java], [1.0]) if single else (list(java.trees()), list(java.treeWeights()))
    boosted = not single and "GBT" in type(tree_model).__name__
    total = 1.0 if boosted or single else float(sum(weights))
    classes = not boosted and "Classification" in type(tree_model).__name__
    out: list[Leaf] = []
    for tree, weight in zip(trees, weights):
        _walk(tree.rootNode(), weight / total, classes, {}, out)
    return out


def _walk(node, weight: float, classes: bool, path: dict, out: list[Leaf]) -> None:
    if node.getClass().getSimpleName() == "LeafNode":
        counts = list(node.impurityStats().stats()) if classes else []
        value = counts[1] / sum(counts) if classes else node.prediction()
        out.append(Leaf(weight * value, [(f, tests, share) for f, (tests, share) in path.items()]))
        return
    split, rows = node.split(), float(node.impurityStats().count())
    f = split.featureIndex()
    if split.getClass().getSimpleName() == "CategoricalSplit":
        names = ", ".join(f"{float(c)!r}D" for c in split.leftCategories())
        tests = (f"__x[{f}] IN ({names})", f"__x[{f}] NOT IN ({names})")
    else:
        tests = (f"__x[{f}] <= {float(split.threshold())!r}D", f"__x[{f}] > {float(split.threshold())!r}D")
    for child, test in zip((node.leftChild(), node.rightChild()), tests):
        old, share = path.get(f, ([], 1.0))
        _walk(child, weight, classes, {**path, f: ([*old, test], share * float(child.impurityStats().count()) / rows)}, out)


def leaf_values(value: float, shares: Sequence[float]) -> np.ndarray:
    """Shapley values of ``value`` * product of the tests, by (outcome, feature);
    bit j of the outcome says that feature j's tests hold."""
    m = len(shares)
    held = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
    # weight[k]: of a set of k known features, among the m - 1 others.
    weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
    out = np.zeros((2**m, m))
    for j in range(m):
        # sums[k]: over the sets of k others, tests of the set times shares of the rest.
        sums = [np.ones(2**m)]
        for i in range(m):
            if i != j:
                grown = [s * shares[i] for s in sums] + [np.zeros(2**m)]
                for k, s in enumerate(sums):
                    grown[k + 1] = grown[k + 1] + s * held[:, i]
                sums = grown
        out[:, j] = value * (held[:, j] - shares[j]) * sum(w * s for w, s in zip(weight, sums))
    return out


def _sum(terms: list[str]) -> str:
    """The sum as a balanced tree, so that its depth stays small."""
    if not terms:
        return "0D"
    half = len(terms) // 2
    return terms[0] if len(terms) == 1 else f"({_sum(terms[:half])} + {_sum(terms[half:])})"


def add_attributions(df: DataFrame, tree_model, n_features: int, features: str = "features") -> DataFrame:
    """``df`` plus ``attribution`` (array, one value per feature) and ``base``.
    ``features`` is the vector the model was fitted on; no row lacks it."""
    leaves = model_leaves(tree_model)
    size = sum(len(leaf.path) * 2 ** len(leaf.path) for leaf in leaves)
    if size > MAX_CONSTANTS:
        raise ValueError(f"{size} constants, more than {MAX_CONSTANTS}: too deep a model for compiled attributions")
    base, outcomes, terms = 0.0, [], [[] for _ in range(n_features)]
    for leaf in leaves:
        shares = [share for _, _, share in leaf.path]
        base += leaf.value * float(np.prod(shares))
        if not leaf.path:
            continue
        values = leaf_values(leaf.value, shares)
        for j, (f, _, _) in enumerate(leaf.path):
            terms[f].append(f"get(array({', '.join(f'{v!r}D' for v in values[:, j].tolist())}), __o[{len(outcomes)}])")
        outcomes.append(_sum([f"if({' AND '.join(tests)}, {2**j}, 0)" for j, (_, tests, _) in enumerate(leaf.path)]))
    kept = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*kept, vector_to_array(features).alias("__x"))
    rows = rows.select(*kept, F.expr(f"array({', '.join(outcomes) or '0'})").alias("__o"))
    return rows.select(*kept, F.expr(f"array({', '.join(_sum(t) for t in terms)})").alias("attribution"), F.lit(base).alias("base"))


def attribution_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per feature the mean size, the mean and the largest size of its
    attributions, in one aggregate of one row."""
    v = [F.get("attribution", F.lit(i)) for i in range(len(names))]
    one = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(v) for k, f in (("a", lambda x: F.avg(F.abs(x))), ("m", F.avg), ("x", lambda x: F.max(F.abs(x))))])
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"m{i}").alias("mean"), F.col(f"x{i}").alias("max_abs")) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def path_attributions(fitted, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` through the fitted pipeline, with attributions, base and raw
    score; and the names of the features.  ``fitted`` has ``stages`` and
    ``transform`` as :class:`plans.models.FittedModel`."""
    names = next(st for st in fitted.stages if isinstance(st, VectorAssembler)).getInputCols()
    last = fitted.stages[-1]
    out = add_attributions(fitted.transform(rows), last, len(names))
    score = "rawPrediction" if "GBT" in type(last).__name__ else "probability"
    return out.withColumn("raw_score", vector_to_array(score)[1]), names
