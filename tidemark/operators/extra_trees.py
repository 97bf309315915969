"""Extremely randomised trees (K03), grown level by level in Spark.

Every node draws a few features and one random cut for each, uniform between
the node's smallest and largest value; the best of the cuts by Gini gain
splits it.  No bins and no sort: a level of all trees is two grouped
aggregates over the rows, one for the value ranges of its nodes and one for
the weights left of the drawn cuts.

A row's node in a tree is a column: it follows the splits found so far by
array lookups in one row per tree, which a broadcast join on the tree adds.
Nothing is shuffled but partial sums per node, and the tables sent around
have at most ``n_estimators * 2 ** max_depth`` numbers a column.  Fitted trees become ``CASE`` expressions, so scoring adds
one compiled column and moves no row.

Cases: missing values (``SENTINEL``) stand left of every real one; a cut
sometimes parts them from the rest, else it is drawn among real values.  A
constant feature is never drawn; a node without a usable cut, below
``min_samples_split`` rows or of one class is a leaf; a cut that would leave
fewer than ``min_samples_leaf`` rows on a side doesn't count.  Rows of weight
0 count as rows, not in the shares.  Ties go to the cut drawn first.  No
rows, or a missing label, raise.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below every real value; stands for a missing one.
SENTINEL = -1e12

#: Chance that a feature with missing values is cut between them and the rest.
PART_MISSING = 0.25


@dataclass
class Node:
    """A node of a tree; ``share`` is the weighted share of positives of its rows."""

    rows: int
    weight: float
    share: float
    feature: int | None = None
    cut: float | None = None
    gain: float = 0.0


@dataclass
class Forest:
    """Nodes by (tree, node number): 1 is the root, 2 n and 2 n + 1 are the children of n."""

    n_trees: int
    n_features: int
    nodes: dict[tuple[int, int], Node] = field(default_factory=dict)

    def _case(self, tree: int, node: int, x: str) -> str:
        n = self.nodes[tree, node]
        if n.feature is None:
            return f"{n.share!r}D"
        return f"CASE WHEN {x}[{n.feature}] <= {n.cut!r}D THEN {self._case(tree, 2 * node, x)} ELSE {self._case(tree, 2 * node + 1, x)} END"

    def tree_scores(self, x: str) -> list[Column]:
        """The share of the leaf that a row reaches, per tree; ``x`` names an array column."""
        return [F.expr(self._case(t, 1, f"`{x}`")) for t in range(self.n_trees)]

    def score(self, x: str) -> Column:
        """Mean share over the trees."""
        return sum(self.tree_scores(x), F.lit(0.0)) / self.n_trees

    def importances(self) -> list[float]:
        """Share of the summed weighted Gini gain that each feature brought."""
        out = [0.0] * self.n_features
        for n in self.nodes.values():
            if n.feature is not None:
                out[n.feature] += n.gain
        total = sum(out)
        return [v / total if total else 0.0 for v in out]


def gini(weight: float, positive: float) -> float:
    """Weighted Gini impurity of a node: 2 w p (1 - p)."""
    return 2.0 * positive * (weight - positive) / weight if weight > 0 else 0.0


def draw_cuts(rng: random.Random, low: list[float | None], high: list[float | None], missing: list[int], k: int) -> list[tuple[int, float]]:
    """(feature, cut) of up to ``k`` features that are not constant in the node, in random order."""
    order = list(range(len(low)))
    rng.shuffle(order)
    out = []
    for f in order:
        u, part = rng.random(), rng.random()
        lo, hi = low[f], high[f]
        if lo is None or (lo == hi and not missing[f]):
            continue
        if missing[f] and (lo == hi or part < PART_MISSING):
            cut = SENTINEL
        else:
            cut = min(lo + u * (hi - lo), math.nextafter(hi, -math.inf))
        out.append((f, cut))
        if len(out) == k:
            break
    return out


def _features_per_node(rule, n: int) -> int:
    if rule in (None, "all"):
        return n
    if rule in ("sqrt", "auto"):
        return max(1, int(math.sqrt(n)))
    if rule == "log2":
        return max(1, int(math.log2(n)))
    return max(1, int(rule * n)) if isinstance(rule, float) else min(n, int(rule))


def _placed(rows: DataFrame, forest: Forest, depth: int, drawn: dict | None = None, k: int = 0) -> DataFrame:
    """``rows`` with their node of every tree at a depth, missing if they stay in a leaf above it.

    They descend by array lookups in one row per tree; ``drawn`` cuts come
    along as arrays ``f0``, ``c0``, ... by node.
    """
    at = rows.select("x", "y", "w", F.explode(F.sequence(F.lit(0), F.lit(forest.n_trees - 1))).alias("tree"), F.lit(1).alias("node"))
    if not depth and not drawn:
        return at
    trees, leaf = [], Node(0, 0.0, 0.0)
    for t in range(forest.n_trees):
        above = [forest.nodes.get((t, n), leaf) for n in range(1 << depth)]
        cuts = [(drawn or {}).get((t, n), ((), ())) for n in range(2 << depth)]
        tried = [[v[j] if j < len(v) else None for v in by_node] for j in range(k) for by_node in zip(*cuts)]
        trees.append((t, [n.feature for n in above], [n.cut for n in above], *tried))
    schema = "tree int, f array<int>, c array<double>" + "".join(f", f{j} array<int>, c{j} array<double>" for j in range(k))
    # One row per tree, of at most 2 ** depth numbers a column.
    at = at.join(F.broadcast(rows.sparkSession.createDataFrame(trees, schema)), "tree")
    feature = F.get("f", "node")
    for _ in range(depth):
        at = at.withColumn("node", F.when(feature.isNotNull(), 2 * F.col("node") + F.when(F.get("x", feature) <= F.get("c", "node"), 0).otherwise(1)))
    return at


def grow(
    rows: DataFrame,
    n_features: int,
    n_estimators: int = 100,
    max_depth: int = 8,
    min_samples_leaf: int = 1,
    min_samples_split: int = 2,
    max_features="sqrt",
    seed: int = 0,
) -> Forest:
    """Trees on ``rows`` (x array<double>, y 0 or 1, w weight)."""
    spark = rows.sparkSession
    forest, k = Forest(n_estimators, n_features), _features_per_node(max_features, n_features)
    value = lambda f: F.get("x", F.lit(f))
    for depth in range(max_depth + 1):
        real = [F.when(value(f) > SENTINEL, value(f)) for f in range(n_features)] if depth < max_depth else []
        found = _placed(rows, forest, depth).groupBy("tree", "node").agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"), F.count_if(F.col("y").isNull()).alias("bad"),
            *(F.min(r).alias(f"lo{f}") for f, r in enumerate(real)), *(F.max(r).alias(f"hi{f}") for f, r in enumerate(real)),
            *(F.count_if(r.isNull()).alias(f"no{f}") for f, r in enumerate(real)),
        ).collect()
        if depth == 0 and (not found or found[0].bad):
            raise ValueError("trees need rows with labels")
        drawn = []
        for r in sorted((r for r in found if r.node is not None), key=lambda r: (r.tree, r.node)):
            forest.nodes[r.tree, r.node] = Node(r.n, r.w, r.p / r.w if r.w else 0.0)
            if depth < max_depth and r.n >= max(min_samples_split, 2 * min_samples_leaf) and gini(r.w, r.p) > 0:
                rng = random.Random(f"{seed}:{r.tree}:{r.node}")
                cuts = draw_cuts(rng, *([r[f"{c}{f}"] for f in range(n_features)] for c in ("lo", "hi", "no")), k)
                if cuts:
                    drawn.append((r.tree, r.node, [f for f, _ in cuts], [c for _, c in cuts]))
        if not drawn:
            break
        cuts_of = {(t, n): (fs, cs) for t, n, fs, cs in drawn}
        left = [F.get("x", F.get(f"f{j}", "node")) <= F.get(f"c{j}", "node") for j in range(k)]
        tested = _placed(rows, forest, depth, cuts_of, k).groupBy("tree", "node").agg(
            *(F.count_if(c).alias(f"n{j}") for j, c in enumerate(left)), *(F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(f"w{j}") for j, c in enumerate(left)),
            *(F.sum(F.when(c, F.col("w") * F.col("y")).otherwise(0.0)).alias(f"p{j}") for j, c in enumerate(left)),
        ).collect()
        split = False
        for r in sorted((r for r in tested if (r.tree, r.node) in cuts_of), key=lambda r: (r.tree, r.node)):
            own, (fs, cs) = forest.nodes[r.tree, r.node], cuts_of[r.tree, r.node]
            positive = own.share * own.weight
            for j, (f, c) in enumerate(zip(fs, cs)):
                n, w, p = r[f"n{j}"], r[f"w{j}"], r[f"p{j}"]
                gain = gini(own.weight, positive) - gini(w, p) - gini(own.weight - w, positive - p)
                if min(n, own.rows - n) >= min_samples_leaf and (own.feature is None or gain > own.gain):
                    own.feature, own.cut, own.gain = f, c, gain
            split = split or own.feature is not None
        if not split:
            break
    return forest


class ExtraTreesClassifier(Estimator):
    """The trees as a pipeline stage: reads ``features`` and ``label``, adds ``probability``."""

    def __init__(self, seed: int = 0, weight_col: str | None = None, **options):
        super().__init__()
        self.seed, self.weight_col, self.options = seed, weight_col, options

    def setWeightCol(self, name: str) -> ExtraTreesClassifier:  # noqa: N802 - as the other estimators
        self.weight_col = name
        return self

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"))
        first = rows.select(F.size("x")).first()
        return ExtraTreesModel(grow(rows, first[0] if first else 0, seed=self.seed, **self.options))


class ExtraTreesModel(Model):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    @property
    def featureImportances(self):  # noqa: N802 - as the other models
        return Vectors.dense(self.forest.importances())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.forest.score("__x")
        scored = dataset.withColumn("__x", vector_to_array("features")).withColumn("__p", p)
        return scored.withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p")))).drop("__x", "__p")
