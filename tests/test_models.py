"""Model jobs: invariants (AUC in [0, 1], every valid row scored once, finite
scores) and a planted signal that must beat chance."""

from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from tidemark.operators import splits
from tidemark.operators.schema import DRIFT_EXCLUSIONS
from tidemark.plans import models as md
from tidemark.plans import q_models as qm
from tidemark.sources import fixtures as fx


def test_time_fold_model_invariants(spark):
    tr = fx.train_apps(spark, SF_SMALL).withColumn(
        "planted", F.col("target_value") * 2.0 + (F.col("front_id") % 7) / 10.0)
    feats, ncols = md.tree_features(tr, ["loan_amount_last", "balance_amt", "planted"], ["db_group_last"])
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS)
    preds, m = md.evaluate_folds(feats, "decision_day", spec, ncols, ["db_group_last"],
                                 {"model_type": "gbt", "iterations": 5, "depth": 3}, 42)
    rows = {r.fold: r.roc_auc for r in m.collect()}
    assert set(rows) == {"1", "2", "3", "OOF_TIME_HOLDOUT"}
    assert all(0.9 < v <= 1.0 for v in rows.values())
    n_valid = splits.assign_folds(tr, "decision_day", spec).filter("role = 'valid'").count()
    assert preds.count() == n_valid == preds.select("fold", "front_id").distinct().count()
    md.check_scores(preds)


def test_search_draws_are_seeded():
    space = {"depth": {"type": "int", "low": 2, "high": 6}, "lr": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
             "kind": {"type": "categorical", "choices": ["a", "b"]}}
    assert md.draw_trials(space, 5, 1) == md.draw_trials(space, 5, 1)
    assert all(2 <= t["depth"] <= 6 and 0.01 <= t["lr"] <= 0.3 for t in md.draw_trials(space, 20, 3))


# Stored trials, one of them failed.
TRIALS = [({"number": 0, "depth": 3}, 0.71), ({"number": 1, "depth": 2}, None), ({"number": 2, "depth": 4}, 0.74), ({"number": 3, "depth": 4}, 0.74)]


def test_export_orders_stored_trials_and_skips_failed_ones(spark):
    table = md.trial_table(spark, [t for t, _ in TRIALS], [v for _, v in TRIALS])
    assert [(r.number, r.value) for r in md.export_top_trials(table, 3, "s").collect()] == [(2, 0.74), (3, 0.74), (0, 0.71)]


def test_exported_trials_follow_the_tables(spark):
    small, mid = (qm.k14_export_scanned_trials(spark, sf).collect() for sf in (SF_SMALL, SF_MID))
    assert len(small) == len(mid) == 5 and small != mid


def test_search_export_is_the_best_of_the_search(spark):
    best = sorted(qm.k13_parameter_search(spark, SF_SMALL).collect(), key=lambda r: (-r.value, r.number))[:2]
    assert [(r.number, r.value) for r in qm.k14_export_search_trials(spark, SF_SMALL).collect()] == [(r.number, r.value) for r in best]


def test_drift_forest_gives_all_exclusion_sets(spark):
    rows = qm.k09_drift_forest(spark, SF_SMALL).collect()
    features = {name: {r.feature for r in rows if r.exclusion_set == name and r.feature} for name in DRIFT_EXCLUSIONS}
    assert {r.exclusion_set for r in rows} == set(DRIFT_EXCLUSIONS)
    assert len({frozenset(f) for f in features.values()}) == 4
    assert all(sum(r.exclusion_set == name and r.holdout_auc is not None for r in rows) == 2 for name in DRIFT_EXCLUSIONS)


def test_drift_forest_rows_hold_every_application_and_offer(spark):
    rows, a, o = qm._application_offers(spark, SF_SMALL), fx.apps(spark, SF_SMALL), fx.offers(spark, SF_SMALL)
    alone = a.join(o, a["front_id"] == o["l_orderkey"], "left_anti").count()
    assert rows.count() == rows.select("row_key").distinct().count() == o.count() + alone
    sides = splits.stratified_split(rows, "is_test", "front_id", 42).groupBy("front_id").agg(F.count_distinct("is_train").alias("n"))
    assert sides.filter("n > 1").isEmpty()


def test_equal_column_lists_give_rows_under_each_name(spark):
    a = fx.apps(spark, SF_SMALL)
    out = md.drift_forest_sets(a.filter("is_test = 0"), a.filter("is_test = 1"), {"x": ["cnt_30"], "y": ["cnt_30"]}, [], 42, "front_id",
                               {"model_type": "rf", "n_estimators": 2, "depth": 2})
    x, y = ([r for r in out.drop("exclusion_set").filter(out["exclusion_set"] == n).collect()] for n in "xy")
    assert x and x == y
