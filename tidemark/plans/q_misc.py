"""Checks for the remaining small operators
(B07, B11, B13, C15, C27, C30, E36, F02, F05, F06, G02-G04, L06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalar as sc
from ..functions.params import typed_value
from ..operators import blend as bl
from ..operators import metrics
from ..operators import reshape as rs
from ..operators import weights as wt
from ..operators.ranks import join_back
from ..operators.schema import DRIFT_EXCLUSIONS, confident_rows, feature_variants
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .catalog import query
from .q_folds import auc_sql

W = fx.with_views
NUM = ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90"]
CAT = ["db_group_last", "fl_adminarea"]


@query("b07_id_membership_semi_anti", W("apps") + """, u AS (SELECT DISTINCT user_id FROM events)
SELECT is_test, COUNT(*) FILTER (WHERE cust_id IN (SELECT user_id FROM u)) AS in_set,
  COUNT(*) FILTER (WHERE cust_id NOT IN (SELECT user_id FROM u)) AS not_in_set FROM apps GROUP BY is_test""")
def b07_id_membership_semi_anti(spark, sf):
    a = fx.apps(spark, sf)
    u = read_table(spark, sf, "events", ["user_id"]).select(F.col("user_id").alias("cust_id")).distinct()
    semi = a.join(u, "cust_id", "left_semi").groupBy("is_test").agg(F.count(F.lit(1)).alias("in_set"))
    anti = a.join(u, "cust_id", "left_anti").groupBy("is_test").agg(F.count(F.lit(1)).alias("not_in_set"))
    return semi.join(anti, "is_test", "full_outer").select(
        "is_test", F.coalesce("in_set", F.lit(0).cast("long")).alias("in_set"),
        F.coalesce("not_in_set", F.lit(0).cast("long")).alias("not_in_set"))


@query("b11_feature_family_variants", W("apps") + """SELECT front_id,
  ROUND(SIGN(loan_amount_last) * LN(1 + ABS(loan_amount_last)), 6) + 0e0 AS loan_amount_last_slog,
  ROUND(SIGN(balance_amt) * LN(1 + ABS(balance_amt)), 6) + 0e0 AS balance_amt_slog,
  COALESCE(CAST(cnt_30 = 0 AS INTEGER), 0) AS cnt_30_is_zero, COALESCE(CAST(cnt_90 = 0 AS INTEGER), 0) AS cnt_90_is_zero,
  CAST(balance_amt IS NULL AS INTEGER) + CAST(cnt_90 IS NULL AS INTEGER) AS n_missing_numeric,
  COUNT(*) OVER (PARTITION BY db_group_last) AS db_group_last_combined_freq, COUNT(*) OVER (PARTITION BY fl_adminarea) AS fl_adminarea_combined_freq,
  CAST(GREATEST(((ROW_NUMBER() OVER (ORDER BY loan_amount_last, front_id) - 1) * 16 + COUNT(*) OVER () - 2) // (COUNT(*) OVER () - 1) - 1, 0) AS BIGINT) AS loan_amount_last_qbin16,
  CAST(GREATEST(((ROW_NUMBER() OVER (ORDER BY cnt_30, front_id) - 1) * 16 + COUNT(*) OVER () - 2) // (COUNT(*) OVER () - 1) - 1, 0) AS BIGINT) AS cnt_30_qbin16,
  COALESCE(db_group_last, '__MISSING__') || '__' || COALESCE(fl_adminarea, '__MISSING__') AS db_group_last__x__fl_adminarea,
  CAST(date_diff('day', (SELECT MIN(decision_day) FROM apps WHERE is_test = 0), decision_day) AS INTEGER) AS day_num,
  strftime(decision_day, '%Y-%m') AS month, CAST(weekofyear(decision_day) AS INTEGER) AS week
FROM apps""")
def b11_feature_family_variants(spark, sf):
    a = fx.apps(spark, sf)
    fit = a.filter("is_test = 0")
    v = feature_variants(NUM, CAT, "decision_day", fit, "front_id")
    # Columns with missing values (balance_amt, cnt_90) have no bins.
    full = v["time_regime"](v["all_label_free"](v["base"](a)))
    assert not {"balance_amt_qbin16", "cnt_90_qbin16"} & set(full.columns)
    return full.select("front_id", *[(F.round(f"{c}_slog", 6) + 0.0).alias(f"{c}_slog") for c in ("loan_amount_last", "balance_amt")],
                       "cnt_30_is_zero", "cnt_90_is_zero", "n_missing_numeric", *[f"{c}_combined_freq" for c in CAT],
                       "loan_amount_last_qbin16", "cnt_30_qbin16", "db_group_last__x__fl_adminarea", "day_num", "month", "week")


@query("b13_drift_exclusion_sets", W("offers") + """SELECT exclusion_set, column_name, n_present FROM (VALUES
  ('all_except_id', 'decision_day'), ('all_except_id', 'offered_rate'), ('all_except_id', 'overdraft_limit_min'), ('all_except_id', 'overdraft_limit_max'),
  ('no_decision_day', 'offered_rate'), ('no_decision_day', 'overdraft_limit_min'), ('no_decision_day', 'overdraft_limit_max'),
  ('no_day_cb_offered', 'overdraft_limit_min'), ('no_day_cb_offered', 'overdraft_limit_max'),
  ('no_day_rate_limits', 'l_linestatus'), ('all_except_id', 'l_linestatus'), ('no_decision_day', 'l_linestatus'), ('no_day_cb_offered', 'l_linestatus')) t(exclusion_set, column_name)
JOIN (SELECT 'decision_day' AS column_name, COUNT(decision_day) AS n_present FROM offers UNION ALL SELECT 'offered_rate', COUNT(offered_rate) FROM offers
  UNION ALL SELECT 'overdraft_limit_min', COUNT(overdraft_limit_min) FROM offers UNION ALL SELECT 'overdraft_limit_max', COUNT(overdraft_limit_max) FROM offers
  UNION ALL SELECT 'l_linestatus', COUNT(l_linestatus) FROM offers) USING (column_name)""")
def b13_drift_exclusion_sets(spark, sf):
    o = fx.offers(spark, sf)
    base = ["decision_day", *fx.OFFER_COLS, "l_linestatus"]
    present = o.agg(*[F.count(c).alias(c) for c in base]).unpivot([], base, "column_name", "n_present")
    out = None
    for name, gone in DRIFT_EXCLUSIONS.items():
        part = present.filter(~F.col("column_name").isin(gone) if gone else F.lit(True)).select(F.lit(name).alias("exclusion_set"), "column_name", "n_present")
        out = part if out is None else out.unionByName(part)
    return out


@query("c15_weekday_monday0", W("apps") + "SELECT front_id, CAST(isodow(decision_day) - 1 AS INTEGER) AS dow FROM apps")
def c15_weekday_monday0(spark, sf):
    return fx.apps(spark, sf).select("front_id", cal.weekday0("decision_day").alias("dow"))


PARAM_TEXT_SQL = """CASE event_type WHEN 'error' THEN 'None' WHEN 'click' THEN 'True' WHEN 'view' THEN 'False'
  WHEN 'purchase' THEN '[' || CAST(event_id % 7 AS VARCHAR) || ', ' || CAST(event_id % 5 AS VARCHAR) || ']'
  ELSE CAST(value AS VARCHAR) END"""


@query("c27_trial_param_typing", W("apps") + f"""SELECT event_id,
  CASE WHEN t = 'None' THEN 'null' WHEN t IN ('True', 'False') THEN 'bool' WHEN regexp_full_match(t, '-?[0-9]+') THEN 'int'
       WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL THEN 'float' WHEN t LIKE '[%]' THEN 'int_list' ELSE 'text' END AS kind,
  CASE WHEN t IN ('True', 'False') THEN t = 'True' END AS bool_value,
  TRY_CAST(t AS DOUBLE) AS float_value,
  CASE WHEN t LIKE '[%]' THEN CAST(list_sum(list_transform(string_split(trim(t, '[]'), ', '), lambda x: CAST(x AS BIGINT))) AS BIGINT) END AS list_sum
FROM (SELECT event_id, {PARAM_TEXT_SQL} AS t FROM events)""")
def c27_trial_param_typing(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "event_type", "value"])
    et = F.col("event_type")
    text = (F.when(et == "error", "None").when(et == "click", "True").when(et == "view", "False")
            .when(et == "purchase", F.concat(F.lit("["), (F.col("event_id") % 7).cast("string"), F.lit(", "),
                                             (F.col("event_id") % 5).cast("string"), F.lit("]")))
            .otherwise(F.col("value").cast("string")))
    t = ev.select("event_id", typed_value(text).alias("p"))
    return t.select("event_id", "p.kind", "p.bool_value", "p.float_value",
                    F.aggregate("p.int_list", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("list_sum"))


@query("c30_positive_class_score", W("apps") + "SELECT COUNT(*) AS n_rows, COUNT(*) AS n_in_range, CAST(0 AS BIGINT) AS n_missing FROM apps WHERE is_test = 1")
def c30_positive_class_score(spark, sf):
    from . import models as md
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1")
    ftr, ncols = md.tree_features(tr, NUM, CAT)
    fte, _ = md.tree_features(te, NUM, CAT)
    pred, _ = md.fit_score(ftr, fte, ncols, CAT, {"model_type": "logreg", "iterations": 20, "clip": 1e-6}, 42)
    md.check_scores(pred)
    p = F.col("prediction")
    return pred.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((p >= 1e-6) & (p <= 1 - 1e-6)).alias("n_in_range"),
                    F.count_if(p.isNull()).alias("n_missing"))


@query("e36_substitution_attribution")
def e36_substitution_attribution(spark, sf):
    from . import models as md
    tr = fx.train_apps(spark, sf)
    feats, ncols = md.tree_features(tr, NUM, CAT)
    model = md.fit_model(feats, ncols, CAT, {"model_type": "logreg", "iterations": 20}, 42)
    return md.substitution_attribution(model, feats, ncols, md.medians(feats, ncols), "front_id")


@query("f02_one_to_one_join_check", W("scores") + """SELECT COUNT(*) AS n_joined, (SELECT COUNT(*) - COUNT(DISTINCT (fold, front_id)) FROM scores) AS left_dups,
  (SELECT COUNT(*) - COUNT(DISTINCT (fold, front_id)) FROM scores WHERE target_value = 1) AS right_dups
FROM scores a JOIN (SELECT fold, front_id FROM scores WHERE target_value = 1) b USING (fold, front_id)""")
def f02_one_to_one_join_check(spark, sf):
    s = fx.scores(spark, sf)
    a, b = s.select("fold", "front_id", "s1"), s.filter("target_value = 1").select("fold", "front_id")
    j = bl.join_predictions(a, b, ["fold", "front_id"], one_to_one=True)
    dup = lambda d: d.groupBy("fold", "front_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long")).scalar()
    return j.agg(F.count(F.lit(1)).alias("n_joined")).select("n_joined", dup(a).alias("left_dups"), dup(b).alias("right_dups"))


@query("f05_weight_lookup_coverage", W("scores") + """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE w IS NULL) AS n_missing FROM scores s
LEFT JOIN (SELECT front_id, 1e0 + fold AS w FROM scores WHERE s2 > 0.1) w USING (front_id)""")
def f05_weight_lookup_coverage(spark, sf):
    s = fx.scores(spark, sf)
    wfile = s.filter(F.col("s2") > 0.1).select("front_id", (F.lit(1.0) + F.col("fold")).alias("w"))
    j = join_back(s.select("front_id"), wfile, ["front_id"], how="left")
    try:
        wt.weights_from_table(s.select("front_id"), wfile.withColumnRenamed("w", "sample_weight"), "front_id")
        raised = False
    except ValueError:
        raised = True
    out = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("w").isNull()).alias("n_missing"))
    assert raised == (out.first()["n_missing"] > 0)
    return out


@query("f06_align_scores_to_ids", W("apps") + """, te AS (SELECT front_id, ROW_NUMBER() OVER (ORDER BY front_id) - 1 AS pos FROM apps WHERE is_test = 1)
SELECT front_id, pos, CAST(front_id % 1000 AS DOUBLE) / 1000e0 AS score FROM te""")
def f06_align_scores_to_ids(spark, sf):
    from ..operators.contract import with_position
    te = fx.test_apps(spark, sf).select("front_id")
    scores = te.select("front_id", ((F.col("front_id") % 1000).cast("double") / 1000.0).alias("score"))
    return bl.align_to_ids(with_position(te, "front_id"), scores, "front_id", "pos")


@query("g02_fold_predictions_one_table", W("scores") + "SELECT fold, front_id AS row_index, target_value, s1 AS prediction FROM scores")
def g02_fold_predictions_one_table(spark, sf):
    s = fx.scores(spark, sf)
    return s.select("fold", F.col("front_id").alias("row_index"), "target_value", F.col("s1").alias("prediction"))


@query("g03_append_summary_rows", W("scores") + ", " + auc_sql("scores", ["fold"], "s2") + """
SELECT CAST(fold AS VARCHAR) AS fold, ROUND(roc_auc, 9) AS roc_auc FROM auc UNION ALL SELECT 'MEAN', ROUND(AVG(roc_auc), 9) FROM auc""")
def g03_append_summary_rows(spark, sf):
    a = metrics.auc_table(fx.scores(spark, sf), "target_value", "s2", ["fold"])
    out = rs.append_summary(a, "fold", "roc_auc", "MEAN", F.avg)
    return out.select("fold", F.round("roc_auc", 9).alias("roc_auc"))


@query("g04_augment_pseudo_rows", W("scores") + """SELECT origin, COUNT(*) AS n_rows, CAST(SUM(target_value) AS BIGINT) AS n_pos, ROUND(SUM(w), 9) AS w_sum FROM (
  SELECT 'base' AS origin, target_value, 1e0 AS w FROM scores WHERE fold < 3
  UNION ALL SELECT 'pseudo', CAST(s1 > 0.5 AS INTEGER), 0.3e0 FROM scores WHERE fold = 3 AND (s1 > 0.9 OR s1 < 0.05)) GROUP BY origin""")
def g04_augment_pseudo_rows(spark, sf):
    s = fx.scores(spark, sf)
    base = s.filter("fold < 3").select(F.lit("base").alias("origin"), "target_value", F.lit(1.0).alias("w"))
    p = confident_rows(s.filter("fold = 3"), "s1", 0.9, 0.05).select(
        F.lit("pseudo").alias("origin"), F.col("pseudo_target").alias("target_value"), wt.constant_weight(0.3).alias("w"))
    return rs.augment(base, p).groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"),
                                                      F.sum("target_value").cast("long").alias("n_pos"),
                                                      F.round(F.sum("w"), 9).alias("w_sum"))


@query("l06_selection_score", W("apps", "scores") + ", " + auc_sql("scores", ["fold"], "s1").replace("auc AS (", "a1 AS (") + """,
h AS (SELECT * FROM (VALUES ('H1', DATE '1999-07-01'), ('H2', DATE '2000-01-01'), ('H3', DATE '2000-04-01')) t(holdout, cutoff)),
v AS (SELECT h.holdout, a.target_value, CAST(a.front_id * 7919 % 1000 + 150 * a.target_value AS DOUBLE) / 1150e0 AS s1
  FROM apps a JOIN h ON a.decision_day >= h.cutoff WHERE a.is_test = 0), """ + auc_sql("v", ["holdout"], "s1").replace(
    "d AS (", "d2 AS (").replace("FROM d", "FROM d2").replace("c AS (", "c2 AS (").replace("FROM c", "FROM c2") + """
SELECT ROUND((SELECT AVG(roc_auc) FROM auc2) + 0.25 * (SELECT roc_auc FROM a1 WHERE fold = 3), 9) AS selection_score,
  ROUND((SELECT AVG(roc_auc) FROM a1), 9) AS fold_mean""")
def l06_selection_score(spark, sf):
    from ..operators import splits
    s = fx.scores(spark, sf)
    folds = metrics.auc_table(s, "target_value", "s1", ["fold"])
    tr = fx.train_apps(spark, sf)
    m = splits.assign_folds(tr, "decision_day", splits.holdout_spec(fx.HOLDOUT_CUTOFFS)).filter("role = 'valid'")
    fid, y = F.col("front_id"), F.col("target_value")
    m = m.withColumn("s1", (fid * 7919 % 1000 + 150 * y).cast("double") / F.lit(1150.0))
    lh = metrics.auc_table(m, "target_value", "s1", ["fold"])
    t = lh.agg(F.avg("roc_auc").alias("lh_mean")).withColumn(
        "fold3_auc", folds.filter("fold = 3").select("roc_auc").scalar())
    return t.select(F.round(bl.selection_score(), 9).alias("selection_score"),
                    F.round(folds.select(F.avg("roc_auc")).scalar(), 9).alias("fold_mean"))
