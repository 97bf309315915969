"""Checks for folds, holdouts, fold-keyed AUC and split contracts
(B06, F10, I01-I03, E21-E23, E34, E39, M04, M07, M08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, splits
from ..sources import fixtures as fx
from .catalog import query

W = fx.with_views

# Shared SQL pieces --------------------------------------------------------

FOLDS_SQL = """tr AS (SELECT * FROM apps WHERE is_test = 0),
f AS (SELECT * FROM (VALUES (1, DATE '1999-01-01'), (2, DATE '1999-07-01'), (3, DATE '2000-01-01')) t(fold, cutoff)),
spec AS (SELECT fold, cutoff,
                COALESCE(LEAD(cutoff) OVER (ORDER BY fold), (SELECT MAX(decision_day) FROM tr) + 1) AS valid_end
         FROM f),
m0 AS (SELECT s.fold, CASE WHEN a.decision_day < s.cutoff THEN 'train' ELSE 'valid' END AS role, a.*
       FROM tr a JOIN spec s ON a.decision_day < s.valid_end),
m AS (SELECT * FROM m0 WHERE fold IN (SELECT fold FROM m0 GROUP BY fold HAVING COUNT(DISTINCT role) = 2))
"""

HOLDOUTS_SQL = """tr AS (SELECT * FROM apps WHERE is_test = 0),
h AS (SELECT * FROM (VALUES ('H1', DATE '1999-07-01'), ('H2', DATE '2000-01-01'), ('H3', DATE '2000-04-01')) t(fold, cutoff)),
m AS (SELECT h.fold, CASE WHEN a.decision_day < h.cutoff THEN 'train' ELSE 'valid' END AS role, a.*
      FROM tr a CROSS JOIN h)
"""

FOLD_STATS = """SELECT fold, role, COUNT(*) AS n_rows, MIN(decision_day) AS day_min, MAX(decision_day) AS day_max,
       CAST(SUM(target_value) AS BIGINT) AS n_pos, CAST(SUM(target_value) AS DOUBLE) / COUNT(*) AS pos_rate
FROM m GROUP BY fold, role"""

# Grouped exact AUC in SQL: distinct scores, negatives strictly below, rank sum.
def auc_sql(src: str, keys: list[str], score: str, label: str = "target_value") -> str:
    k = ", ".join(keys)
    kp = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    grp = f" GROUP BY {k}" if keys else ""
    return f"""d AS (SELECT {kp}{score} AS s, SUM({label}) AS pos, SUM(1 - {label}) AS neg, COUNT(*) AS n
       FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {kp}{score}),
c AS (SELECT *, COALESCE(SUM(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d),
auc AS (SELECT {kp}CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
              THEN CAST(SUM(pos * (2 * nb + neg)) AS DOUBLE) / (2 * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) END AS roc_auc,
       CAST(SUM(n) AS BIGINT) AS n_rows, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
       FROM c{grp})"""


def _train(spark, sf):
    return fx.train_apps(spark, sf)


def _folds(spark, sf):
    tr = _train(spark, sf)
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS)
    return splits.drop_empty_folds(splits.assign_folds(tr, "decision_day", spec))


def _holdouts(spark, sf):
    tr = _train(spark, sf)
    spec = splits.holdout_spec(fx.HOLDOUT_CUTOFFS)
    return splits.assign_folds(tr, "decision_day", spec)


def _s2(df):
    fid, y = F.col("front_id"), F.col("target_value")
    return df.withColumn("s2", (fid * 104729 % 97 + 12 * y).cast("double") / F.lit(109.0))


def _s1(df):
    fid, y = F.col("front_id"), F.col("target_value")
    return df.withColumn("s1", (fid * 7919 % 1000 + 150 * y).cast("double") / F.lit(1150.0))


S1_SQL = "CAST(front_id * 7919 % 1000 + 150 * target_value AS DOUBLE) / 1150e0"
S2_SQL = "CAST(front_id * 104729 % 97 + 12 * target_value AS DOUBLE) / 109e0"


# Queries -------------------------------------------------------------------

@query("i01_rolling_time_folds", W("apps") + ", " + FOLDS_SQL + FOLD_STATS)
def i01_rolling_time_folds(spark, sf):
    return splits.fold_table(_folds(spark, sf), "decision_day", "target_value")


@query("f10_fold_membership", W("apps") + ", " + FOLDS_SQL + "SELECT front_id, fold, role FROM m")
def f10_fold_membership(spark, sf):
    return _folds(spark, sf).select("front_id", "fold", "role")


@query("e34_fold_table", W("apps") + ", " + FOLDS_SQL + """, st AS (""" + FOLD_STATS + """)
SELECT v.fold, f.cutoff, t.day_min AS train_start, t.day_max AS train_end, v.day_min AS valid_start, v.day_max AS valid_end,
       t.n_rows AS train_rows, v.n_rows AS valid_rows, v.pos_rate AS valid_pos_rate
FROM st v JOIN st t ON v.fold = t.fold AND v.role = 'valid' AND t.role = 'train' JOIN f ON f.fold = v.fold""")
def e34_fold_table(spark, sf):
    st = splits.fold_table(_folds(spark, sf), "decision_day", "target_value")
    v = st.filter(F.col("role") == "valid").alias("v")
    t = st.filter(F.col("role") == "train").alias("t")
    cut = spark.createDataFrame([(i + 1, c) for i, c in enumerate(fx.FOLD_CUTOFFS)], "fold int, c string").select(
        "fold", F.col("c").cast("date").alias("cutoff"))
    return (
        v.join(t, "fold").join(F.broadcast(cut), "fold")
        .select("fold", "cutoff", F.col("t.day_min").alias("train_start"), F.col("t.day_max").alias("train_end"),
                F.col("v.day_min").alias("valid_start"), F.col("v.day_max").alias("valid_end"),
                F.col("t.n_rows").alias("train_rows"), F.col("v.n_rows").alias("valid_rows"),
                F.col("v.pos_rate").alias("valid_pos_rate"))
    )


@query("i02_recent_window_folds", W("apps") + """, tr AS (SELECT * FROM apps WHERE is_test = 0),
f AS (SELECT * FROM (VALUES (1, DATE '1999-01-01'), (2, DATE '1999-07-01'), (3, DATE '2000-01-01')) t(fold, cutoff)),
spec AS (SELECT fold, cutoff, cutoff - INTERVAL 180 DAY AS train_start,
                COALESCE(LEAD(cutoff) OVER (ORDER BY fold), (SELECT MAX(decision_day) FROM tr) + 1) AS valid_end FROM f),
m AS (SELECT s.fold, CASE WHEN a.decision_day < s.cutoff THEN 'train' ELSE 'valid' END AS role, a.*
      FROM tr a JOIN spec s ON a.decision_day < s.valid_end AND a.decision_day >= CAST(s.train_start AS DATE))
""" + FOLD_STATS)
def i02_recent_window_folds(spark, sf):
    tr = _train(spark, sf)
    spec = splits.fold_spec(tr, "decision_day", fx.FOLD_CUTOFFS, window_days=180)
    return splits.fold_table(splits.assign_folds(tr, "decision_day", spec), "decision_day", "target_value")


@query("i03_late_holdouts", W("apps") + ", " + HOLDOUTS_SQL + FOLD_STATS)
def i03_late_holdouts(spark, sf):
    return splits.fold_table(_holdouts(spark, sf), "decision_day", "target_value")


@query("b06_date_interval_filter", W("apps") + """SELECT COUNT(*) AS n_rows, CAST(SUM(target_value) AS BIGINT) AS n_pos,
       MIN(decision_day) AS day_min, MAX(decision_day) AS day_max
FROM apps WHERE decision_day >= DATE '1999-07-01' AND decision_day <= DATE '2000-06-30'""")
def b06_date_interval_filter(spark, sf):
    a = fx.apps(spark, sf)
    d = F.col("decision_day")
    return a.filter((d >= F.lit("1999-07-01").cast("date")) & (d <= F.lit(fx.TRAIN_END).cast("date"))).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target_value").cast("long").alias("n_pos"),
        F.min(d).alias("day_min"), F.max(d).alias("day_max"))


@query("e21_exact_auc", W("scores") + ", " + auc_sql("scores", ["fold"], "s2") + " SELECT * FROM auc")
def e21_exact_auc(spark, sf):
    return metrics.auc_table(fx.scores(spark, sf), "target_value", "s2", ["fold"])


@query("e22_fold_and_pooled_auc", W("scores") + ", " + auc_sql("scores", ["fold"], "s1") + """,
pooled AS (SELECT 'OOF_TIME_HOLDOUT' AS fold, roc_auc, n_rows, n_pos FROM (""" + "WITH " + auc_sql("scores", [], "s1") + """ SELECT * FROM auc))
SELECT CAST(fold AS VARCHAR) AS fold, roc_auc, n_rows, n_pos FROM auc UNION ALL SELECT * FROM pooled""")
def e22_fold_and_pooled_auc(spark, sf):
    return metrics.fold_auc(fx.scores(spark, sf), "target_value", "s1", "fold")


@query("e23_holdout_battery", W("apps") + ", " + HOLDOUTS_SQL + """, v AS (SELECT fold AS holdout, target_value, """ + S2_SQL + """ AS s2 FROM m WHERE role = 'valid'),
""" + auc_sql("v", ["holdout"], "s2") + """
SELECT holdout, ROUND(roc_auc, 6) AS roc_auc FROM auc
UNION ALL SELECT 'MEAN', ROUND(AVG(roc_auc), 6) FROM auc
UNION ALL SELECT 'STD', ROUND(STDDEV_POP(roc_auc), 6) FROM auc
UNION ALL SELECT 'MIN', ROUND(MIN(roc_auc), 6) FROM auc""")
def e23_holdout_battery(spark, sf):
    v = _s2(_holdouts(spark, sf).filter(F.col("role") == "valid")).withColumnRenamed("fold", "holdout")
    aucs = metrics.auc_table(v, "target_value", "s2", ["holdout"])
    return metrics.holdout_battery(aucs).select("holdout", F.round("roc_auc", 6).alias("roc_auc"))


@query("e39_late_part_auc", W("apps") + """, v AS (SELECT target_value, """ + S1_SQL + """ AS s1 FROM apps
WHERE is_test = 0 AND decision_day >= DATE '2000-04-01'), """ + auc_sql("v", [], "s1") + " SELECT * FROM auc")
def e39_late_part_auc(spark, sf):
    tr = _s1(_train(spark, sf))
    return metrics.late_part_auc(tr, "target_value", "s1", "decision_day", "2000-04-01")


@query("m04_two_classes_per_fold", W("apps") + ", " + FOLDS_SQL + """SELECT fold, role, MIN(target_value) < MAX(target_value) AS two_classes
FROM m GROUP BY fold, role""")
def m04_two_classes_per_fold(spark, sf):
    return _folds(spark, sf).groupBy("fold", "role").agg(
        (F.min("target_value") < F.max("target_value")).alias("two_classes"))


@query("m07_no_future_leak", W("apps") + ", " + FOLDS_SQL + """, t AS (SELECT fold, MAX(decision_day) AS max_train_day FROM m WHERE role = 'train' GROUP BY fold),
v AS (SELECT fold, MIN(decision_day) AS min_valid_day FROM m WHERE role = 'valid' GROUP BY fold),
sh AS (SELECT a.fold, COUNT(*) AS n_shared FROM m a JOIN m b ON a.fold = b.fold AND a.front_id = b.front_id
       AND a.role = 'train' AND b.role = 'valid' GROUP BY a.fold)
SELECT t.fold, max_train_day, min_valid_day, max_train_day < min_valid_day AS ordered, COALESCE(n_shared, 0) AS n_shared
FROM t JOIN v ON t.fold = v.fold LEFT JOIN sh ON sh.fold = t.fold""")
def m07_no_future_leak(spark, sf):
    m = _folds(spark, sf)
    t = m.filter(F.col("role") == "train").groupBy("fold").agg(F.max("decision_day").alias("max_train_day"))
    v = m.filter(F.col("role") == "valid").groupBy("fold").agg(F.min("decision_day").alias("min_valid_day"))
    a = m.filter(F.col("role") == "train").select("fold", "front_id")
    b = m.filter(F.col("role") == "valid").select("fold", "front_id")
    sh = a.join(b, ["fold", "front_id"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n_shared"))
    return t.join(v, "fold").join(sh, "fold", "left").select(
        "fold", "max_train_day", "min_valid_day",
        (F.col("max_train_day") < F.col("min_valid_day")).alias("ordered"),
        F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))


@query("m08_nonempty_splits", W("apps") + ", " + HOLDOUTS_SQL + """SELECT fold, COUNT(*) FILTER (WHERE role = 'train') AS train_rows,
       COUNT(*) FILTER (WHERE role = 'valid') AS valid_rows,
       COUNT(*) FILTER (WHERE role = 'train') > 0 AND COUNT(*) FILTER (WHERE role = 'valid') > 0 AS non_empty
FROM m GROUP BY fold""")
def m08_nonempty_splits(spark, sf):
    m = _holdouts(spark, sf)
    tr = F.count_if(F.col("role") == "train")
    va = F.count_if(F.col("role") == "valid")
    return m.groupBy("fold").agg(tr.alias("train_rows"), va.alias("valid_rows"), ((tr > 0) & (va > 0)).alias("non_empty"))
