"""The weighted networks: gradients, weights, early stop, cases, folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import network as nw
from tidemark.operators import splits
from tidemark.plans import models as md
from tidemark.sources import fixtures as fx


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    sizes = (3, 5, 4, 1)
    x, y, w = rng.normal(size=(30, 3)), rng.integers(0, 2, 30).astype(float), rng.random(30)
    flat = nw.start(sizes, 1) + 0.1 * rng.normal(size=len(nw.start(sizes, 1)))
    loss, grad = nw.gradient(x, y, w, flat, sizes, 2.5)
    assert abs(loss - nw.losses(nw.forward(x, flat, sizes)[0], y, w, 2.5).sum()) < 1e-12
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (nw.gradient(x, y, w, flat + s, sizes, 2.5)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-4


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    out = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        # No straight line parts the classes.
        out.append((i, [a, b], int(a * b + rng.gauss(0, 0.2) > 0.3), rng.choice([1.0, 2.0, 3.0]), i % 3))
    return spark.createDataFrame(out, "i int, x array<double>, y int, w double, part int").repartition(5).cache()


SIDES = ["one", "two"]


def fit(rows, *args, **options):
    sides = {"one": (F.col("part") < 2, F.col("part") == 2), "two": (F.col("part") > 0, F.col("part") == 0)}
    return nw.fit_networks(rows, sides, "x", "y", 2, *args, **options)


def test_sums_over_tasks_equal_one_batch(rows):
    n = fit(rows, "w", hidden=(4,), steps=1, pos_weight="balanced")
    got = rows.collect()
    for name, train in (("one", {0, 1}), ("two", {1, 2})):
        own, other = [r for r in got if r.part in train], [r for r in got if r.part not in train]
        x, y, w = (np.array([r[c] for r in own], float) for c in ("x", "y", "w"))
        pos = w[y == 0].sum() / w[y == 1].sum()
        loss, grad = nw.gradient(x, y, w, nw.start((2, 4, 1), 42), (2, 4, 1), pos)
        assert abs(n[name].pos_weight - pos) < 1e-9 and abs(n[name].train_losses[0] - loss / w.sum()) < 1e-9
        vx, vy, vw = (np.array([r[c] for r in other], float) for c in ("x", "y", "w"))
        z = nw.forward(vx, nw.start((2, 4, 1), 42), (2, 4, 1))[0]
        assert abs(n[name].valid_losses[0] - nw.losses(z, vy, vw, pos).sum() / vw.sum()) < 1e-9


def test_networks_learn_stop_and_keep_the_best(rows):
    nets = fit(rows, "w", hidden=(12,), steps=40, patience=3, rate=0.05)
    for net in nets.values():
        assert net.valid_losses[net.best_step] <= min(net.valid_losses) + 1e-4 and net.valid_losses[net.best_step] < 0.8 * net.valid_losses[0]
    fast = fit(rows, hidden=(12,), steps=40, patience=2, rate=3.0)
    assert all(n.steps_run < 40 and len(n.valid_losses) == n.best_step + 3 for n in fast.values())
    again = fit(rows, "w", hidden=(12,), steps=2, rate=0.05)
    assert np.allclose(again["one"].train_losses, nets["one"].train_losses[:3])


def test_a_weight_counts_as_copies(rows):
    copies = rows.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    a = fit(rows, "w", hidden=(4,), steps=3)
    b = fit(copies, hidden=(4,), steps=3)
    assert all(np.allclose(a[m].flat, b[m].flat) for m in SIDES)


def test_missing_values_one_class_and_empty_table(spark, rows):
    bad = spark.createDataFrame(
        [(0, [1.0, None], 1, 1.0, 0), (1, None, 0, 1.0, 0), (2, [1.0, 2.0], None, 1.0, 1), (3, [1.0, float("nan")], 0, 1.0, 1), (4, [1.0, 1.0], 1, None, 1), (5, [9.0, 1.0], 1, -1.0, 1), (6, [1.0], 1, 1.0, 1)], rows.schema)
    a = fit(rows, "w", hidden=(4,), steps=2)
    b = fit(rows.union(bad), "w", hidden=(4,), steps=2)
    assert all(np.allclose(a[m].flat, b[m].flat) for m in SIDES)
    score = nw.network_score(F.when(F.col("i") == 4, "none").otherwise("one"), F.col("x"), a)
    got = {r.i: r.p for r in bad.withColumn("p", score).collect()}
    assert [i for i, p in got.items() if p is not None] == [2, 5] and 0 < got[2] < 1
    empty = fit(rows.limit(0), hidden=(4,), steps=2)
    assert all(n.steps_run == 0 and len(n.flat) == 17 for n in empty.values())
    single = fit(rows.filter("y = 1"), hidden=(4,), steps=2)
    assert all(n.pos_weight == 1.0 and np.isfinite(n.flat).all() for n in single.values())
    with pytest.raises(ValueError, match="pos_weight"):
        fit(rows, pos_weight="twice")


def test_fold_networks_score_every_valid_row(spark):
    tr = fx.train_apps(spark, SF_SMALL).withColumn("planted", F.col("target_value") * 2.0 + (F.col("front_id") % 7) / 10.0).withColumn("w", F.lit(2.0))
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS)
    preds, m = md.network_folds(tr, "decision_day", spec, ["planted", "balance_amt"], ["db_group_last"], weight_col="w", hidden=(8,), steps=12, rate=0.05)
    got = {r.fold: r for r in m.collect()}
    assert got.keys() == {"1", "2", "3", "OOF_TIME_HOLDOUT"} and all(got[f].roc_auc > 0.9 and got[f].best_step > 0 for f in "123")
    assert preds.count() == preds.select("fold", "front_id").distinct().count() > 0
    md.check_scores(preds)
