"""Extremely randomised trees against a plain grower on the same draws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import extra_trees as et
from tidemark.operators import splits
from tidemark.plans import models as md
from tidemark.sources import fixtures as fx


def slow_tree(x, y, w, tree, depth, leaf, k, seed):
    """One tree grown on all rows in memory; the same random draws per node."""
    nodes = {}

    def go(node, rows, level):
        weight, positive = sum(w[i] for i in rows), sum(w[i] * y[i] for i in rows)
        out = nodes[node] = [len(rows), weight, positive / weight if weight else 0.0, None, None]
        if level == depth or len(rows) < max(2, 2 * leaf) or et.gini(weight, positive) <= 0:
            return
        real = [[x[i][f] for i in rows if x[i][f] > et.SENTINEL] for f in range(len(x[0]))]
        low, high = ([g(r) if r else None for r in real] for g in (min, max))
        best = None
        for f, cut in et.draw_cuts(random.Random(f"{seed}:{tree}:{node}"), low, high, [len(rows) - len(r) for r in real], k):
            left = [i for i in rows if x[i][f] <= cut]
            lw, lp = sum(w[i] for i in left), sum(w[i] * y[i] for i in left)
            gain = et.gini(weight, positive) - et.gini(lw, lp) - et.gini(weight - lw, positive - lp)
            if min(len(left), len(rows) - len(left)) >= leaf and (best is None or gain > best[0]):
                best = gain, f, cut, left
        if best:
            out[3:] = best[1:3]
            inside = set(best[3])
            go(2 * node, best[3], level + 1)
            go(2 * node + 1, [i for i in rows if i not in inside], level + 1)

    go(1, list(range(len(x))), 0)
    return nodes


def noisy_rows(n, seed):
    rng = random.Random(seed)
    x = [[rng.choice([et.SENTINEL, rng.gauss(0, 1), float(rng.randint(0, 3))]), rng.gauss(0, 1), 7.0, float(rng.randint(0, 1))] for _ in range(n)]
    y = [float((r[1] > 0.3) != (rng.random() < 0.15)) for r in x]
    return x, y, [float(rng.choice([0, 1, 1, 2, 4])) for _ in range(n)]


@pytest.mark.parametrize("leaf, k", [(1, 2), (5, 4), (3, 1)])
def test_trees_equal_a_plain_grower(spark, leaf, k):
    x, y, w = noisy_rows(220, leaf)
    df = spark.createDataFrame(list(zip(x, y, w)), "x array<double>, y double, w double").repartition(5)
    forest = et.grow(df, 4, n_estimators=4, max_depth=5, min_samples_leaf=leaf, max_features=k, seed=9)
    for t in range(4):
        want = slow_tree(x, y, w, t, 5, leaf, k, 9)
        got = {n: [v.rows, v.weight, v.share, v.feature, v.cut] for (tree, n), v in forest.nodes.items() if tree == t}
        assert got.keys() == want.keys()
        for n in want:
            assert got[n][:2] == want[n][:2] and got[n][3:] == want[n][3:] and abs(got[n][2] - want[n][2]) < 1e-12
        assert all(v[0] >= leaf and v[3] != 2 for v in got.values())
    scores = [r[0] for r in df.select("x", forest.score("x").alias("s")).select("s").collect()]
    walk = []
    for r in df.select("x").collect():
        total = 0.0
        for t in range(4):
            n = 1
            while (node := forest.nodes[t, n]).feature is not None:
                n = 2 * n + (r.x[node.feature] > node.cut)
            total += node.share
        walk.append(total / 4)
    assert np.allclose(scores, walk) and abs(sum(forest.importances()) - 1) < 1e-9


def test_cuts_part_missing_values_and_never_leave_a_side_empty():
    rng = random.Random(2)
    for _ in range(300):
        lo = rng.choice([-1e300, -3.0, 0.0, 5.0])
        hi = rng.choice([lo, math.nextafter(lo, math.inf), lo + 1, 1e300])
        missing = rng.choice([0, 4])
        for f, cut in et.draw_cuts(rng, [lo, None], [hi, None], [missing, 9], 2):
            assert f == 0 and (cut == et.SENTINEL and missing or lo <= cut < hi)
        if lo == hi and not missing:
            assert et.draw_cuts(rng, [lo], [hi], [0], 1) == []


def test_time_folds_with_weights_find_a_planted_signal(spark):
    tr = fx.train_apps(spark, SF_SMALL).withColumn("planted", F.col("target_value") * 2.0 + (F.col("front_id") % 7) / 10.0)
    feats, ncols = md.tree_features(tr.withColumn("w", F.lit(2.0)), ["loan_amount_last", "planted"], ["db_group_last"])
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS)
    cfg = {"model_type": "extra_trees", "n_estimators": 10, "depth": 4, "min_samples_leaf": 5, "max_features": "all", "class_weight": "balanced"}
    preds, m = md.evaluate_folds(feats, "decision_day", spec, ncols, ["db_group_last"], cfg, 42, weight_col="w")
    assert all(0.9 < r.roc_auc <= 1.0 for r in m.collect())
    md.check_scores(preds)
    model = md.fit_model(feats, ncols, ["db_group_last"], cfg, 42)
    assert dict(md.importances(model))["f_planted"] > 0.5


def test_no_rows_or_missing_labels_raise(spark):
    df = spark.createDataFrame([([1.0], None, 1.0)], "x array<double>, y double, w double")
    with pytest.raises(ValueError):
        et.grow(df, 1)
    with pytest.raises(ValueError):
        et.grow(df.limit(0), 1)
    one = et.grow(df.withColumn("y", F.lit(1.0)), 1, n_estimators=2)
    assert one.nodes.keys() == {(0, 1), (1, 1)} and df.select(one.score("x")).first()[0] == 1.0


def test_rows_find_their_nodes_with_one_join(spark):
    # Tree 0 splits its root and its right child, tree 1 is a leaf.
    nodes = {(0, 1): (0, 0.5), (0, 2): (None, None), (0, 3): (1, 2.0), (0, 6): (None, None), (0, 7): (None, None), (1, 1): (None, None)}
    forest = et.Forest(2, 2, {k: et.Node(1, 1.0, 0.5, f, c) for k, (f, c) in nodes.items()})
    rows = spark.range(6).selectExpr("array(id % 2, double(id)) as x", "1.0D as y", "1.0D as w")
    at = et._placed(rows, forest, 2)
    assert at._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    assert sorted((r.tree, r.x[1], r.node) for r in at.collect() if r.node is not None) == [(0, 1.0, 6), (0, 3.0, 7), (0, 5.0, 7)]
    assert {(r.tree, r.node) for r in et._placed(rows, forest, 1).collect()} == {(0, 2), (0, 3), (1, None)}
