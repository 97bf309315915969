"""Checks for segment statistics, target and frequency encoders and inner
folds (E14-E17, F03, I05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoders as enc
from ..operators import splits
from ..sources import fixtures as fx
from .catalog import query

W = fx.with_views
FIT = "fit AS (SELECT * FROM apps WHERE is_test = 0 AND decision_day < DATE '2000-01-01')"
REST = "rest AS (SELECT * FROM apps WHERE NOT (is_test = 0 AND decision_day < DATE '2000-01-01'))"


def _fit_rest(spark, sf):
    a = fx.apps(spark, sf)
    cond = (F.col("is_test") == 0) & (F.col("decision_day") < F.lit("2000-01-01").cast("date"))
    return a.filter(cond), a.filter(~cond)


def _seg_sql(cat: str, nums: list[str], min_count: int) -> tuple[str, list[str]]:
    aggs, cols = [], []
    for n in nums:
        p = f"{cat}__{n}__seg_"
        ok = f"COUNT({n}) >= {min_count}"
        aggs += [f"CASE WHEN {ok} THEN AVG({n}) END AS {p}mean", f"CASE WHEN {ok} THEN STDDEV_SAMP({n}) END AS {p}std",
                 f"CASE WHEN {ok} THEN COUNT({n}) END AS {p}count"]
        q = f"{cat}__{n}__"
        mean, std = f"s_{cat}.{p}mean", f"s_{cat}.{p}std"
        cols += [f"ROUND({mean}, 6) AS {p}mean", f"ROUND({std}, 6) AS {p}std", f"{p}count",
                 f"ROUND(a.{n} - {mean}, 6) + 0e0 AS {q}minus_seg_mean",
                 f"ROUND(CASE WHEN ABS({mean}) > 1e-12 THEN a.{n} / {mean} END, 6) + 0e0 AS {q}to_seg_mean",
                 f"ROUND(CASE WHEN ABS({std}) > 1e-12 THEN (a.{n} - {mean}) / {std} END, 6) + 0e0 AS {q}seg_zscore"]
    cte = f"s_{cat} AS (SELECT {cat}, " + ", ".join(aggs) + f" FROM fit WHERE {cat} IS NOT NULL GROUP BY {cat})"
    return cte, cols


_S1, _C1 = _seg_sql("db_group_last", ["loan_amount_last", "balance_amt"], 20)
_S2, _C2 = _seg_sql("fl_adminarea", ["balance_amt"], 450)


@query("e14_f03_segment_stats", W("apps") + ", " + FIT + ", " + _S1 + ", " + _S2 + "\nSELECT a.front_id, " + ", ".join(_C1 + _C2) + """
FROM apps a LEFT JOIN s_db_group_last ON a.db_group_last = s_db_group_last.db_group_last
LEFT JOIN s_fl_adminarea ON a.fl_adminarea = s_fl_adminarea.fl_adminarea""")
def e14_f03_segment_stats(spark, sf):
    fit, _ = _fit_rest(spark, sf)
    a = fx.apps(spark, sf)
    out = enc.segment_stats(fit, a, ["db_group_last"], ["loan_amount_last", "balance_amt"], min_count=20)
    out = enc.segment_stats(fit, out, ["fl_adminarea"], ["balance_amt"], min_count=450)
    new = [c for c in out.columns if "__" in c]
    cols = []
    for c in new:
        if c.endswith("seg_count"):
            cols.append(F.col(c))
        else:
            cols.append((F.round(c, 6) + 0.0).alias(c))
    return out.select("front_id", *cols)


@query("e15_smoothed_target_map", W("apps") + ", " + FIT + """
SELECT fl_adminarea, ROUND((SUM(target_value) + (SELECT AVG(target_value) FROM fit) * 50e0) / (COUNT(*) + 50e0), 9) AS te
FROM fit WHERE fl_adminarea IS NOT NULL GROUP BY fl_adminarea""")
def e15_smoothed_target_map(spark, sf):
    fit, _ = _fit_rest(spark, sf)
    prior = fit.select(F.avg("target_value")).scalar()
    m = enc.smoothed_target_map(fit, "fl_adminarea", "target_value", 50.0, prior)
    return m.select("fl_adminarea", F.round("te", 9).alias("te"))


def _te_sql(cat: str) -> str:
    return f"""tot_{cat} AS (SELECT {cat}, SUM(target_value) AS s, COUNT(*) AS n FROM fk WHERE {cat} IS NOT NULL GROUP BY {cat}),
per_{cat} AS (SELECT {cat}, k, SUM(target_value) AS s, COUNT(*) AS n FROM fk WHERE {cat} IS NOT NULL GROUP BY {cat}, k)"""


@query("e16_foldsafe_target_encoding", W("apps") + ", " + FIT + ", " + REST + """,
pr AS (SELECT AVG(target_value) AS prior FROM fit),
fk AS (SELECT *, CAST((ROW_NUMBER() OVER (PARTITION BY target_value ORDER BY front_id) - 1) % 5 AS INTEGER) AS k FROM fit),
""" + _te_sql("fl_adminarea") + ", " + _te_sql("db_group_last") + """
SELECT 'fit' AS part, fk.front_id,
  ROUND(COALESCE((t1.s - p1.s + prior * 50e0) / (t1.n - p1.n + 50e0), prior), 9) AS fl_adminarea__foldsafe_te,
  ROUND(COALESCE((t2.s - p2.s + prior * 50e0) / (t2.n - p2.n + 50e0), prior), 9) AS db_group_last__foldsafe_te
FROM fk CROSS JOIN pr LEFT JOIN tot_fl_adminarea t1 ON fk.fl_adminarea = t1.fl_adminarea
LEFT JOIN per_fl_adminarea p1 ON fk.fl_adminarea = p1.fl_adminarea AND fk.k = p1.k
LEFT JOIN tot_db_group_last t2 ON fk.db_group_last = t2.db_group_last
LEFT JOIN per_db_group_last p2 ON fk.db_group_last = p2.db_group_last AND fk.k = p2.k
UNION ALL
SELECT 'rest', rest.front_id, ROUND(COALESCE((t1.s + prior * 50e0) / (t1.n + 50e0), prior), 9),
  ROUND(COALESCE((t2.s + prior * 50e0) / (t2.n + 50e0), prior), 9)
FROM rest CROSS JOIN pr LEFT JOIN tot_fl_adminarea t1 ON rest.fl_adminarea = t1.fl_adminarea
LEFT JOIN tot_db_group_last t2 ON rest.db_group_last = t2.db_group_last""")
def e16_foldsafe_target_encoding(spark, sf):
    fit, rest = _fit_rest(spark, sf)
    cats = ["fl_adminarea", "db_group_last"]
    f, r = enc.foldsafe_target_encoding(fit, rest, cats, "target_value", smoothing=50.0, inner_splits=5,
                                        order_cols=["front_id"])
    cols = [F.round(f"{c}__foldsafe_te", 9).alias(f"{c}__foldsafe_te") for c in cats]
    return f.select(F.lit("fit").alias("part"), "front_id", *cols).unionByName(
        r.select(F.lit("rest").alias("part"), "front_id", *cols))


@query("e17_frequency_encoding", W("apps") + """, c AS (SELECT fl_adminarea, COUNT(*) AS n FROM apps GROUP BY fl_adminarea)
SELECT front_id, n AS fl_adminarea_freq, n / (SELECT COUNT(*) FROM apps) AS fl_adminarea_share
FROM apps JOIN c ON apps.fl_adminarea IS NOT DISTINCT FROM c.fl_adminarea""")
def e17_frequency_encoding(spark, sf):
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1")
    out = enc.frequency_encoding([tr, te], a, "fl_adminarea", "fl_adminarea_freq")
    out = enc.frequency_encoding([tr, te], out, "fl_adminarea", "fl_adminarea_share", share=True)
    return out.select("front_id", "fl_adminarea_freq", "fl_adminarea_share")


@query("i05_stratified_inner_folds", W("apps") + ", " + FIT + """
SELECT front_id, target_value, CAST((ROW_NUMBER() OVER (PARTITION BY target_value ORDER BY front_id) - 1) % 5 AS INTEGER) AS inner_fold FROM fit""")
def i05_stratified_inner_folds(spark, sf):
    fit, _ = _fit_rest(spark, sf)
    k = splits.effective_k(fit, "target_value", 5)
    return splits.stratified_kfold(fit, "target_value", ["front_id"], k).select("front_id", "target_value", "inner_fold")
