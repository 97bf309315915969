"""Pairwise slopes and losses against all pairs, and the fitted ranker."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import pairwise as pw
from tidemark.operators import splits
from tidemark.plans import models as md
from tidemark.sources import fixtures as fx


@pytest.mark.parametrize("split", [False, True])
def test_slopes_equal_all_pairs(spark, split):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([0, 1, None, 0, 1]), rng.choice([None, 0.0, 1.0, rng.gauss(0, 1), float(rng.randint(-2, 2)), rng.gauss(0, 30)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, y int, s double")
    hot = pw.hot_groups(df, ["g"], 100) if split else None
    got = {r.i: r for r in pw.pair_slopes(df, ["g"], "y", "s", hot).collect()}
    good = [r for r in rows if None not in r]
    assert got.keys() == {r[0] for r in good}
    slope, loss, pairs = defaultdict(float), defaultdict(float), defaultdict(int)
    for i, g, y, s in good:
        for j, h, z, t in good:
            if g == h and y == 1 and z == 0:
                m = max(0.0, 1 - (s - t))
                slope[i] -= 2 * m
                slope[j] += 2 * m
                loss[i] += m * m
                pairs[i] += 1
    for i, r in got.items():
        assert abs(r.pair_slope - slope[i]) < 1e-6 and abs(r.pair_loss - loss[i]) < 1e-5 and r.pairs == pairs[i]


def test_ranker_learns_the_order_within_days_of_every_fold(spark):
    rng = random.Random(5)
    # The day's level says nothing: the order within the day does.
    labels = [(f, d, rng.randint(0, 1)) for f in ("1", "2") for d in range(20) for _ in range(15)]
    rows = [(f, d, [d * 3.0 + 2.0 * y + rng.gauss(0, 1), rng.gauss(0, 1)], y) for f, d, y in labels]
    df = spark.createDataFrame(rows, "fold string, day int, x array<double>, y int")
    weights, seen = pw.fit_pairwise(df, "fold", "day", "x", "y", 2, iterations=8)
    assert weights.keys() == {"1", "2"} and all(w[0] > 3 * abs(w[1]) for w in weights.values())
    assert all(min(h) < 0.6 * h[0] for h in seen.values())
    scored = df.withColumn("s", pw.by_model(F.col("fold"), F.col("x"), weights))
    got = {r.fold: r for r in pw.within_group_auc(scored, ["fold"], "day", "y", "s").collect()}
    for f in ("1", "2"):
        own = [(d, w0, y) for g, d, (w0, w1), y in rows if g == f for w0 in [weights[f][0] * w0 + weights[f][1] * w1]]
        right = [(a > b) + 0.5 * (a == b) for d, a, y in own for e, b, z in own if d == e and y == 1 and z == 0]
        assert got[f].n_pairs == len(right) and abs(got[f].within_auc - sum(right) / len(right)) < 1e-9 and got[f].within_auc > 0.85


def test_fold_rankers_score_every_valid_row(spark):
    tr = fx.train_apps(spark, SF_SMALL).withColumn("planted", F.col("target_value") * 2.0 + (F.col("front_id") % 7) / 10.0)
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS)
    preds, m = md.rank_folds(tr, "decision_day", spec, ["planted", "balance_amt"], ["db_group_last"], iterations=3)
    assert all(r.roc_auc > 0.9 for r in m.collect()) and {r.fold for r in m.collect()} == {"1", "2", "3"}
    assert preds.count() == preds.select("fold", "front_id").distinct().count() > 0
    md.check_scores(preds)
