"""Property and invariant tests modelled on the reference's own tests:
leakage, fold order, weight rules, output contracts, and the scale paths
(bucketed prefix sums, skew-safe context features) against the simple ones."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import blend as bl
from tidemark.operators import context as ctx
from tidemark.operators import contract as ct
from tidemark.operators import ranks, splits
from tidemark.operators import weights as wt
from tidemark.operators.metrics import auc_table
from tidemark.plans import config as cf
from tidemark.sources import fixtures as fx


def _skewed(spark):
    # One score value holds a third of the rows (the hot-key case).
    s = fx.scores(spark, SF_SMALL)
    return s.withColumn("s_hot", F.when(F.col("front_id") % 3 == 0, F.lit(0.5)).otherwise(F.col("s1")))


def test_few_and_many_buckets_agree(spark, monkeypatch):
    s = _skewed(spark)
    a1 = sorted(auc_table(s, "target_value", "s_hot", ["fold"]).collect())
    o1 = sorted(ranks.ordinal_rank_pct(s, "s_hot", "front_id", "r").select("front_id", "r").collect())
    r1 = sorted(ranks.average_rank_pct(s, "s_hot", "r").select("front_id", "r").collect())
    monkeypatch.setattr(ranks, "BUCKETS", 2)
    assert sorted(auc_table(s, "target_value", "s_hot", ["fold"]).collect()) == a1
    assert sorted(ranks.ordinal_rank_pct(s, "s_hot", "front_id", "r").select("front_id", "r").collect()) == o1
    assert sorted(ranks.average_rank_pct(s, "s_hot", "r").select("front_id", "r").collect()) == r1


def test_context_strategies_agree(spark):
    o = fx.offers(spark, SF_SMALL)
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "overdraft_limit_max"]
    w = ctx.context_features(o, ["l_orderkey"], fx.OFFER_COLS, strategy="window")
    a = ctx.context_features(o, ["l_orderkey"], fx.OFFER_COLS, strategy="aggregate")
    feats = [c for c in w.columns if c not in o.columns]

    def rows(df):
        return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in df.select(*cols, *feats).collect())
    assert rows(w) == rows(a)


def test_features_are_label_free(spark):
    a = fx.apps(spark, SF_SMALL)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1").drop("target_value")
    cfg = {"id_col": "front_id", "day_col": "decision_day", "target": "target_value",
           "categorical": ["db_group_last", "fl_adminarea"], "time_features": {"include_day_num": True},
           "feature_engineering": {"enabled": True}, "excluded_features": ["cust_id", "is_test"]}

    def build(df):
        return cf.build_features(df, te, cfg, [("r", "cnt_30", "cnt_90", "ratio")])[0]
    assert ct.label_free(build, tr, "target_value", "front_id")
    x, _, names, _ = cf.build_features(tr, te, cfg)
    assert not {"front_id", "target_value", "decision_day"} & set(names)


def test_config_rejects_id_or_target_exclusion():
    with pytest.raises(ValueError):
        cf.load_config({"id_col": "id", "day_col": "d", "target": "y", "excluded_features": ["y"]})


def test_folds_do_not_leak(spark):
    tr = fx.train_apps(spark, SF_SMALL)
    m = splits.assign_folds(tr, "decision_day", splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS))
    per = m.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("decision_day"))).alias("mt"),
                                F.min(F.when(F.col("role") == "valid", F.col("decision_day"))).alias("mv")).collect()
    assert len(per) == 3 and all(r.mt < r.mv for r in per)
    shared = m.filter("role = 'train'").select("fold", "front_id").intersect(m.filter("role = 'valid'").select("fold", "front_id"))
    assert shared.count() == 0


def test_weights_rules(spark):
    tr = fx.train_apps(spark, SF_SMALL)
    assert wt.sample_weights(tr, "decision_day", {"enabled": False}) is None
    w = wt.sample_weights(tr, "decision_day", {"enabled": True, "strategy": "exponential_recency",
                                               "half_life_days": 120, "min_weight": 0.25})
    row = w.agg(F.min("sample_weight").alias("mn"), F.avg("sample_weight").alias("avg")).first()
    assert row.mn > 0 and abs(row.avg - 1.0) < 1e-9
    with pytest.raises(ValueError):
        wt.sample_weights(tr, "decision_day", {"enabled": True, "strategy": "nope"})


def test_weight_file_missing_ids_raise(spark):
    tr = fx.train_apps(spark, SF_SMALL)
    ids = [r.front_id for r in tr.select("front_id").orderBy("front_id").limit(10).collect()]
    wfile = tr.filter(~F.col("front_id").isin(ids)).select("front_id", F.lit(1.0).alias("sample_weight"))
    with pytest.raises(ValueError, match="10 ids"):
        wt.weights_from_table(tr, wfile, "front_id")


def test_submission_contract(spark):
    te = fx.test_apps(spark, SF_SMALL).select("front_id")
    scores = te.select("front_id", (F.col("front_id") % 100 / 100.0).alias("target_value"))
    sub = ct.submission_table(te, scores, "front_id")
    checks = ct.submission_contract(sub, te, "front_id")
    ct.assert_passed(checks)
    bad = sub.withColumn("target_value", F.col("target_value") + 2)
    assert not all(r.passed for r in ct.submission_contract(bad, te, "front_id").collect())
    with pytest.raises(ValueError):
        ct.submission_table(te, scores.limit(5), "front_id")


def test_pooled_auc_is_not_fold_mean(spark):
    s = fx.scores(spark, SF_SMALL)
    rows = {r.fold: r.roc_auc for r in bl.scan_1d(s, "s1", "s2", "target_value", ["fold"], [0.0]).collect()}
    assert 0.0 <= rows["OOF"] <= 1.0 and len(rows) == 4


def test_one_class_auc_is_null(spark):
    s = fx.scores(spark, SF_SMALL).filter("target_value = 1")
    assert auc_table(s, "target_value", "s1").first().roc_auc is None


def test_hot_context_key_aggregate_path(spark, monkeypatch):
    """One context holding a third of all rows: the skew-safe path (with the
    bucketed prefix forced) equals the plain window path."""
    o = fx.offers(spark, SF_SMALL)
    o = o.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "overdraft_limit_max"]
    w = ctx.context_features(o, ["l_orderkey"], fx.OFFER_COLS, strategy="window")
    monkeypatch.setattr(ranks, "BUCKETS", 16)
    a = ctx.context_features(o, ["l_orderkey"], fx.OFFER_COLS, hot_rows=50)
    feats = [c for c in w.columns if c not in o.columns]

    def rows(df):
        return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in df.select(*cols, *feats).collect())
    assert rows(w) == rows(a)
