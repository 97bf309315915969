"""Checks for ranks, blends, scans, gates and prediction-set joins
(D06-D14, E27, E29, E30, E31, E37, F01, F02, F11, F12, L01-L10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blend as bl
from ..operators import metrics
from ..operators.ranks import average_rank_pct_multi, equal_count_bins, prefix_sums
from ..session import cut_lineage
from ..sources import fixtures as fx
from .catalog import query
from .q_folds import HOLDOUTS_SQL, auc_sql

W = fx.with_views


def rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    p2 = f"PARTITION BY {part + ', ' if part else ''}{col}"
    return (f"((RANK() OVER ({p}ORDER BY {col}) - 1) + (COUNT(*) OVER ({p2}) + 1) / 2) / COUNT(*) OVER ({p.strip()})")


S3_SQL = "CAST(front_id * 31 % 211 + 40 * target_value AS DOUBLE) / 251e0"


def _scores(spark, sf):
    s = fx.scores(spark, sf)
    fid, y = F.col("front_id"), F.col("target_value")
    return s.withColumn("s3", (fid * 31 % 211 + 40 * y).cast("double") / F.lit(251.0))


SC3 = "sc AS (SELECT *, " + S3_SQL + " AS s3 FROM scores)"


def _ranked(spark, sf, cols=("s1", "s2"), keys=("fold",)):
    return average_rank_pct_multi(_scores(spark, sf), list(cols), [f"r_{c}" for c in cols], list(keys))


@query("d06_rank_normalize_global", W("scores") + f"SELECT front_id, {rank_sql('s2')} AS r FROM scores")
def d06_rank_normalize_global(spark, sf):
    return bl.rank_normalize(fx.scores(spark, sf), "s2", "r").select("front_id", "r")


@query("d07_rank_ordinal_ties", W("scores") + """, x AS (SELECT front_id, CASE WHEN front_id % 6 = 0 THEN NULL ELSE s2 END AS v FROM scores)
SELECT front_id, CASE WHEN v IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY v IS NULL ORDER BY v, front_id) / COUNT(v) OVER () END AS r FROM x""")
def d07_rank_ordinal_ties(spark, sf):
    s = fx.scores(spark, sf).withColumn("v", F.when(F.col("front_id") % 6 != 0, F.col("s2")))
    return bl.rank_ordinal(s, "v", "front_id", "r").select("front_id", "r")


@query("d08_rank_per_fold", W("scores") + f"SELECT front_id, fold, {rank_sql('s2', 'fold')} AS r FROM scores")
def d08_rank_per_fold(spark, sf):
    return bl.rank_normalize(fx.scores(spark, sf), "s2", "r", ["fold"]).select("front_id", "fold", "r")


@query("d09_equal_count_bins", W("apps") + """, r AS (SELECT front_id, ROW_NUMBER() OVER (ORDER BY loan_amount_last, front_id) AS rn, COUNT(*) OVER () AS n,
  balance_amt, ROW_NUMBER() OVER (PARTITION BY balance_amt IS NULL ORDER BY balance_amt, front_id) AS rb, COUNT(balance_amt) OVER () AS nb FROM apps)
SELECT front_id, CAST(GREATEST(((rn - 1) * 16 + n - 2) // (n - 1) - 1, 0) AS BIGINT) AS loan_amount_last_q16,
  CASE WHEN balance_amt IS NOT NULL THEN CAST(GREATEST(((rb - 1) * 16 + nb - 2) // (nb - 1) - 1, 0) AS BIGINT) END AS balance_amt_q16 FROM r""")
def d09_equal_count_bins(spark, sf):
    a = equal_count_bins(fx.apps(spark, sf), "loan_amount_last", "front_id", "loan_amount_last_q16", 16)
    return equal_count_bins(a, "balance_amt", "front_id", "balance_amt_q16", 16).select("front_id", "loan_amount_last_q16", "balance_amt_q16")


@query("d10_segment_rank_mix", W("scores") + f""", x AS (SELECT *, CAST(FLOOR(s2 * 4) AS INTEGER) AS seg FROM scores)
SELECT front_id, ROUND(0.7e0 * {rank_sql('s1', 'fold')} + 0.3e0 * {rank_sql('s1', 'fold, seg')}, 12) AS mix FROM x""")
def d10_segment_rank_mix(spark, sf):
    s = fx.scores(spark, sf).withColumn("seg", F.floor(F.col("s2") * 4).cast("int"))
    return bl.segment_rank_mix(s, "s1", "seg", 0.3, "mix", ["fold"]).select("front_id", F.round("mix", 12).alias("mix"))


@query("d11_position_signal", W("scores") + f"""SELECT front_id, ROUND({rank_sql('s1', 'fold')} + 0.05e0 * {rank_sql('front_id', 'fold')}, 12) AS adj FROM scores""")
def d11_position_signal(spark, sf):
    s = bl.rank_normalize(fx.scores(spark, sf), "s1", "r1", ["fold"])
    return bl.position_signal(s, "r1", "front_id", 0.05, "adj", ["fold"]).select("front_id", F.round("adj", 12).alias("adj"))


@query("d12_stable_row_index", W("apps") + """SELECT front_id, ROW_NUMBER() OVER (ORDER BY front_id) - 1 AS row_index FROM apps""")
def d12_stable_row_index(spark, sf):
    a = fx.apps(spark, sf).select("front_id").withColumn("__one", F.lit(1))
    return prefix_sums(a, [], ["front_id"], ["__one"]).select("front_id", F.col("__one_before").cast("long").alias("row_index"))


@query("d13_first_value_per_day", W("apps") + """SELECT decision_day, arg_min(loan_amount_last, front_id) AS first_amount FROM apps GROUP BY decision_day""")
def d13_first_value_per_day(spark, sf):
    return fx.apps(spark, sf).groupBy("decision_day").agg(F.min_by("loan_amount_last", "front_id").alias("first_amount"))


@query("d14_top_n_per_group", W("apps") + """SELECT fl_adminarea, front_id, loan_amount_last FROM apps
QUALIFY ROW_NUMBER() OVER (PARTITION BY fl_adminarea ORDER BY loan_amount_last DESC, front_id) <= 3""")
def d14_top_n_per_group(spark, sf):
    # row_number() <= N is planned with a partial per-group limit before the
    # shuffle (WindowGroupLimit), so a hot group does not move all its rows.
    a = fx.apps(spark, sf)
    w = Window.partitionBy("fl_adminarea").orderBy(F.desc("loan_amount_last"), "front_id")
    return a.withColumn("__rn", F.row_number().over(w)).filter("__rn <= 3").select("fl_adminarea", "front_id", "loan_amount_last")


@query("l01_weighted_sum_blend", W("scores") + ", " + SC3 + """SELECT front_id, 0.7e0 * s1 + 0.04e0 * s2 + 0.26e0 * s3 AS blend FROM sc""")
def l01_weighted_sum_blend(spark, sf):
    s = _scores(spark, sf)
    return s.select("front_id", bl.weighted_sum({"s1": 0.7, "s2": 0.04, "s3": 0.26}).alias("blend"))


@query("l02_rank_blend", W("scores") + f"""SELECT front_id, fold, ROUND(0.7e0 * {rank_sql('s1', 'fold')} + 0.3e0 * {rank_sql('s2', 'fold')}, 12) AS blend FROM scores""")
def l02_rank_blend(spark, sf):
    return bl.rank_blend(fx.scores(spark, sf), "s1", "s2", 0.3, "blend", ["fold"]).select(
        "front_id", "fold", F.round("blend", 12).alias("blend"))


SCAN_W = bl.weight_grid_1d(0.05, 0.5)
WVALUES = ", ".join(f"({w!r}e0)" for w in SCAN_W)

RANKED_SQL = f"""rk AS (SELECT front_id, fold, target_value, {rank_sql('s1', 'fold')} AS r_s1, {rank_sql('s2', 'fold')} AS r_s2,
  {rank_sql('s3', 'fold')} AS r_s3 FROM sc)"""


@query("l03_f11_weight_scan_1d", W("scores") + ", " + SC3 + ", " + RANKED_SQL + f""", wt AS (SELECT * FROM (VALUES {WVALUES}) t(w)),
x AS (SELECT w, CAST(fold AS VARCHAR) AS fold, target_value, (1e0 - w) * r_s1 + w * r_s2 AS b FROM rk CROSS JOIN wt),
xp AS (SELECT w, 'OOF' AS fold, target_value, b FROM x), """ + auc_sql("x", ["w", "fold"], "b") + """, per AS (SELECT w, fold, roc_auc FROM auc),
""" + auc_sql("xp", ["w", "fold"], "b").replace("d AS (", "d2 AS (").replace("FROM d", "FROM d2").replace("c AS (", "c2 AS (").replace(
    "FROM c", "FROM c2").replace("auc AS (", "auc2 AS (") + " SELECT * FROM per UNION ALL SELECT w, fold, roc_auc FROM auc2")
def l03_f11_weight_scan_1d(spark, sf):
    return bl.scan_1d(_ranked(spark, sf), "r_s1", "r_s2", "target_value", ["fold"], SCAN_W)


@query("l04_simplex_scan", W("scores") + ", " + SC3 + ", " + RANKED_SQL + """, g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(20 - i - j AS INTEGER) AS k
  FROM range(21) a(i), range(21) b(j) WHERE i + j <= 20),
x AS (SELECT i, j, k, fold, target_value, (CAST(i AS DOUBLE) / 20e0) * r_s1 + (CAST(j AS DOUBLE) / 20e0) * r_s2 + (CAST(k AS DOUBLE) / 20e0) * r_s3 AS b
  FROM rk CROSS JOIN g), """ + auc_sql("x", ["i", "j", "k", "fold"], "b") + " SELECT i, j, k, fold, roc_auc FROM auc")
def l04_simplex_scan(spark, sf):
    r = _ranked(spark, sf, ("s1", "s2", "s3"))
    return bl.scan_simplex(r, ["r_s1", "r_s2", "r_s3"], "target_value", ["fold"], 20)


LATE_SQL = HOLDOUTS_SQL + """, late AS (SELECT fold AS holdout, front_id, target_value,
  CAST(front_id * 7919 % 1000 + 150 * target_value AS DOUBLE) / 1150e0 AS s1,
  CAST(front_id * 104729 % 97 + 12 * target_value AS DOUBLE) / 109e0 AS s2 FROM m WHERE role = 'valid')"""


def _late(spark, sf):
    from ..operators import splits
    tr = fx.train_apps(spark, sf)
    m = splits.assign_folds(tr, "decision_day", splits.holdout_spec(fx.HOLDOUT_CUTOFFS))
    fid, y = F.col("front_id"), F.col("target_value")
    return m.filter(F.col("role") == "valid").select(
        F.col("fold").alias("holdout"), "front_id", "target_value",
        ((fid * 7919 % 1000 + 150 * y).cast("double") / F.lit(1150.0)).alias("s1"),
        ((fid * 104729 % 97 + 12 * y).cast("double") / F.lit(109.0)).alias("s2"))


@query("l05_l07_gated_selection", W("apps", "scores") + ", " + SC3 + ", " + RANKED_SQL + f""", wt AS (SELECT * FROM (VALUES {WVALUES}) t(w)),
x AS (SELECT w, fold, target_value, (1e0 - w) * r_s1 + w * r_s2 AS b FROM rk CROSS JOIN wt WHERE fold = 3),
""" + auc_sql("x", ["w"], "b") + """, f3 AS (SELECT w, roc_auc AS fold3_auc FROM auc),
""" + LATE_SQL + f""", lr AS (SELECT holdout, target_value, {rank_sql('s1', 'holdout')} AS r1, {rank_sql('s2', 'holdout')} AS r2 FROM late),
y AS (SELECT w, holdout, target_value, (1e0 - w) * r1 + w * r2 AS b FROM lr CROSS JOIN wt),
""" + auc_sql("y", ["w", "holdout"], "b").replace("d AS (", "d2 AS (").replace("FROM d", "FROM d2").replace("c AS (", "c2 AS (").replace(
    "FROM c", "FROM c2").replace("auc AS (", "auc2 AS (") + """,
lh AS (SELECT w, AVG(roc_auc) AS lh_mean, MIN(roc_auc) AS lh_min FROM auc2 GROUP BY w),
t AS (SELECT f3.w, fold3_auc, lh_mean, lh_min FROM f3 JOIN lh ON f3.w = lh.w),
ch AS (SELECT fold3_auc AS c3, lh_mean AS cm, lh_min AS cn FROM t WHERE w = 0)
SELECT w, ROUND(fold3_auc, 9) AS fold3_auc, ROUND(lh_mean, 9) AS lh_mean, ROUND(lh_min, 9) AS lh_min,
  fold3_auc >= c3 + -0.0002 AS fold3_gate, (lh_mean IS NULL OR lh_mean >= cm + -0.001) AND (lh_min IS NULL OR lh_min >= cn + -0.002) AS lh_gate,
  COALESCE(lh_min >= cn - 1e-6, TRUE) AS reference_gate, fold3_auc >= c3 + -0.0002 AND (lh_mean IS NULL OR lh_mean >= cm + -0.001)
    AND (lh_min IS NULL OR lh_min >= cn + -0.002) AND COALESCE(lh_min >= cn - 1e-6, TRUE) AS pass_all_gates,
  ROUND(lh_mean + 0.25 * fold3_auc, 9) AS selection_score,
  CASE WHEN lh_min - cn >= -0.001 AND lh_mean - cm >= 0 THEN 'PASS_WITH_RISKS' ELSE 'RETEST' END AS verdict FROM t, ch""")
def l05_l07_gated_selection(spark, sf):
    r = _ranked(spark, sf).filter(F.col("fold") == 3)
    f3 = bl.scan_1d(r, "r_s1", "r_s2", "target_value", [], SCAN_W).withColumnRenamed("roc_auc", "fold3_auc")
    late = _late(spark, sf)
    late = bl.rank_normalize(late, "s1", "r1", ["holdout"])
    late = bl.rank_normalize(late, "s2", "r2", ["holdout"])
    lh = bl.scan_1d(late, "r1", "r2", "target_value", ["holdout"], SCAN_W, pooled=False).groupBy("w").agg(
        F.avg("roc_auc").alias("lh_mean"), F.min("roc_auc").alias("lh_min"))
    t = cut_lineage(f3.join(lh, "w"))
    ch = t.filter(F.col("w") == 0)
    c3, cm, cn = (ch.select(F.col(c)).scalar() for c in ("fold3_auc", "lh_mean", "lh_min"))
    t = bl.gate(t, c3, cm, cn, reference_lh_min=cn)
    return t.select("w", F.round("fold3_auc", 9).alias("fold3_auc"), F.round("lh_mean", 9).alias("lh_mean"),
                    F.round("lh_min", 9).alias("lh_min"), "fold3_gate", "lh_gate", "reference_gate", "pass_all_gates",
                    F.round(bl.selection_score(), 9).alias("selection_score"),
                    bl.verdict(F.col("lh_mean") - cm, F.col("lh_min") - cn).alias("verdict"))


@query("l08_seed_average_rank", W("scores") + f""", seeds AS (SELECT * FROM (VALUES (1), (2), (3)) t(seed)),
long AS (SELECT seed, fold, front_id, CAST(front_id * (7919 + seed) % 1000 + 150 * target_value AS DOUBLE) / 1150e0 AS s FROM scores, seeds),
r AS (SELECT fold, front_id, {rank_sql('s', 'seed, fold')} AS r FROM long)
SELECT fold, front_id, ROUND(AVG(r), 9) AS avg_rank FROM r GROUP BY fold, front_id""")
def l08_seed_average_rank(spark, sf):
    s = fx.scores(spark, sf)
    seeds = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed")
    long = s.select("fold", "front_id", "target_value", seeds)
    long = long.withColumn("s", (F.col("front_id") * (7919 + F.col("seed")) % 1000 + 150 * F.col("target_value")).cast("double") / F.lit(1150.0))
    out = bl.seed_average_rank(long, "s", "front_id", "seed", ["fold"], "avg_rank")
    return out.withColumn("avg_rank", F.round("avg_rank", 9))


@query("l09_a06_submission_table", W("apps") + f""", te AS (SELECT front_id, CAST(front_id * 7919 % 1000 AS DOUBLE) / 1150e0 AS s1,
  CAST(front_id * 104729 % 97 AS DOUBLE) / 109e0 AS s2 FROM apps WHERE is_test = 1),
b AS (SELECT front_id, 0.3e0 * {rank_sql('s1')} + 0.7e0 * {rank_sql('s2')} AS target_value FROM te)
SELECT front_id, printf('%.10f', target_value) AS target_value_text, ROW_NUMBER() OVER (ORDER BY front_id) - 1 AS pos FROM b""")
def l09_a06_submission_table(spark, sf):
    from ..operators.contract import submission_table
    te = fx.test_apps(spark, sf)
    fid = F.col("front_id")
    te = te.select("front_id", ((fid * 7919 % 1000).cast("double") / F.lit(1150.0)).alias("s1"),
                   ((fid * 104729 % 97).cast("double") / F.lit(109.0)).alias("s2"))
    b = bl.rank_blend(te, "s1", "s2", 0.7, "target_value")
    sub = submission_table(te.select("front_id"), b.select("front_id", "target_value"), "front_id")
    return sub.select("front_id", F.format_string("%.10f", "target_value").alias("target_value_text"), "pos")


@query("l10_compare_to_champion", W("apps") + ", " + LATE_SQL + """, lg AS (SELECT 's1' AS model, holdout, target_value, s1 AS s FROM late
  UNION ALL SELECT 's2', holdout, target_value, s2 FROM late), """ + auc_sql("lg", ["model", "holdout"], "s") + """,
ch AS (SELECT holdout, roc_auc AS champion_auc FROM auc WHERE model = 's1')
SELECT model, holdout, roc_auc, champion_auc, roc_auc - champion_auc AS delta FROM auc JOIN ch USING (holdout)""")
def l10_compare_to_champion(spark, sf):
    late = _late(spark, sf)
    lg = late.select("holdout", "target_value", F.lit("s1").alias("model"), F.col("s1").alias("s")).unionByName(
        late.select("holdout", "target_value", F.lit("s2").alias("model"), F.col("s2").alias("s")))
    aucs = metrics.auc_table(lg, "target_value", "s", ["model", "holdout"]).select("model", "holdout", "roc_auc")
    return bl.compare_to_champion(aucs, "model", "holdout", "s1")


@query("e27_score_correlations", W("scores") + f""", r AS (SELECT fold, s1, s2, {rank_sql('s1', 'fold')} AS r1, {rank_sql('s2', 'fold')} AS r2 FROM scores)
SELECT fold, ROUND(CORR(s1, s2), 6) + 0e0 AS pearson, ROUND(CORR(r1, r2), 6) + 0e0 AS spearman FROM r GROUP BY fold""")
def e27_score_correlations(spark, sf):
    r = bl.rank_normalize(fx.scores(spark, sf), "s1", "r1", ["fold"])
    r = bl.rank_normalize(r, "s2", "r2", ["fold"])
    c = metrics.correlations(r, "s1", "s2", ["fold"], "r1", "r2")
    return c.select("fold", (F.round("pearson", 6) + 0.0).alias("pearson"), (F.round("spearman", 6) + 0.0).alias("spearman"))


@query("e29_pivot_metrics", W("scores") + ", " + SC3 + """, lg AS (SELECT 's1' AS model, fold, target_value, s1 AS s FROM sc UNION ALL
  SELECT 's2', fold, target_value, s2 FROM sc UNION ALL SELECT 's3', fold, target_value, s3 FROM sc), """ + auc_sql("lg", ["model", "fold"], "s") + """
SELECT model, FIRST(roc_auc) FILTER (WHERE fold = 1) AS fold_1, FIRST(roc_auc) FILTER (WHERE fold = 2) AS fold_2,
  FIRST(roc_auc) FILTER (WHERE fold = 3) AS fold_3 FROM auc GROUP BY model""")
def e29_pivot_metrics(spark, sf):
    s = _scores(spark, sf)
    lg = s.unpivot(["fold", "target_value"], ["s1", "s2", "s3"], "model", "s")
    aucs = metrics.auc_table(lg, "target_value", "s", ["model", "fold"])
    p = aucs.groupBy("model").pivot("fold", [1, 2, 3]).agg(F.first("roc_auc"))
    return p.select("model", F.col("1").alias("fold_1"), F.col("2").alias("fold_2"), F.col("3").alias("fold_3"))


@query("e30_prediction_profile", W("scores") + """SELECT fold, COUNT(*) AS n_rows, MIN(s2) AS min, ROUND(AVG(s2), 9) AS mean, MAX(s2) AS max,
  COUNT(DISTINCT s2) AS n_distinct, COUNT(*) FILTER (WHERE isnan(s2)) AS n_nan, COUNT(*) FILTER (WHERE isinf(s2)) AS n_inf FROM scores GROUP BY fold""")
def e30_prediction_profile(spark, sf):
    p = metrics.score_profile(fx.scores(spark, sf), "s2", ["fold"])
    return p.withColumn("mean", F.round("mean", 9))


@query("e31_weight_profile", W("scores") + """, r AS (SELECT GREATEST(0.01, LEAST(0.99, s1)) / (1 - GREATEST(0.01, LEAST(0.99, s1))) AS r FROM scores),
c AS (SELECT LEAST(r / (SELECT AVG(r) FROM r), 3.0) AS c FROM r), w AS (SELECT c / (SELECT AVG(c) FROM c) AS w FROM c)
SELECT COUNT(*) AS n_rows, ROUND(POW(SUM(w), 2) / SUM(w * w), 6) AS ess, ROUND(POW(SUM(w), 2) / SUM(w * w) / COUNT(*), 6) AS ess_share,
  ROUND(MIN(w), 6) AS w_min, ROUND(MAX(w), 6) AS w_max, ROUND(QUANTILE_CONT(w, 0.99), 6) AS w_p99, COUNT(*) FILTER (WHERE w < 0.01) AS n_below_001 FROM w""")
def e31_weight_profile(spark, sf):
    from ..operators import weights as wt
    w = wt.density_ratio_weights(fx.scores(spark, sf), "s1", 0.01, 3.0)
    p = metrics.weight_profile(w, "sample_weight")
    return p.select("n_rows", *[F.round(c, 6).alias(c) for c in ("ess", "ess_share", "w_min", "w_max", "w_p99")], "n_below_001")


@query("e37_test_weighted_auc", W("scores") + """, d AS (SELECT fold, s1 AS s, SUM(target_value * (0.5e0 + s2)) AS pos, SUM((1 - target_value) * (0.5e0 + s2)) AS neg
  FROM scores GROUP BY fold, s1),
c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d)
SELECT fold, ROUND(SUM(pos * (2 * nb + neg)) / (2 * SUM(pos) * SUM(neg)), 9) AS weighted_auc FROM c GROUP BY fold""")
def e37_test_weighted_auc(spark, sf):
    s = fx.scores(spark, sf).withColumn("w", F.lit(0.5) + F.col("s2"))
    a = metrics.auc_table(s, "target_value", "s1", ["fold"], weight="w", out="weighted_auc")
    return a.select("fold", F.round("weighted_auc", 9).alias("weighted_auc"))


@query("f01_f12_prediction_key_join", W("scores") + """SELECT a.fold, a.front_id, a.s1, b.s2 FROM
  (SELECT fold, front_id, s1 FROM scores) a JOIN (SELECT fold, front_id, s2 FROM scores WHERE s2 >= 0.2e0) b
  ON a.fold = b.fold AND a.front_id = b.front_id""")
def f01_f12_prediction_key_join(spark, sf):
    s = fx.scores(spark, sf)
    a = s.select("fold", "front_id", "s1")
    b = s.filter(F.col("s2") >= 0.2).select("fold", "front_id", "s2")
    return bl.join_predictions(a, b, ["fold", "front_id"], one_to_one=True)
