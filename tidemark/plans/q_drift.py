"""Checks for drift and univariate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..sources import fixtures as fx
from .catalog import query
from .q_folds import auc_sql

W = fx.with_views
DRIFT_COLS = ["decision_day", "loan_amount_last", "balance_amt", "db_group_last", "fl_adminarea", "cnt_90"]
NUM = ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90"]


def _pair(spark, sf):
    a = fx.apps(spark, sf)
    return a.filter("is_test = 0"), a.filter("is_test = 1")


def _long_sql() -> str:
    parts = []
    for c in DRIFT_COLS:
        if c == "decision_day":
            parts.append(f"SELECT '{c}' AS column_name, domain, CAST(date_diff('day', DATE '1970-01-01', {c}) AS DOUBLE) AS x, CAST({c} AS VARCHAR) AS raw FROM b")
        elif c in ("db_group_last", "fl_adminarea"):
            parts.append(f"SELECT '{c}', domain, k.n / (SELECT COUNT(*) FROM b), {c} FROM b JOIN (SELECT COALESCE({c}, '__MISSING__') AS v, COUNT(*) AS n "
                         f"FROM b GROUP BY 1) k ON COALESCE(b.{c}, '__MISSING__') = k.v")
        else:
            parts.append(f"SELECT '{c}', domain, {c}, CAST({c} AS VARCHAR) FROM b")
    return "l AS (" + "\nUNION ALL ".join(parts) + ")"


def _rename(sql: str, n: int) -> str:
    return (sql.replace("d AS (", f"d{n} AS (").replace("FROM d", f"FROM d{n}").replace("c AS (", f"c{n} AS (")
            .replace("FROM c", f"FROM c{n}").replace("auc AS (", f"auc{n} AS ("))


@query("e24_univariate_drift_auc", W("apps") + ", b AS (SELECT *, is_test AS domain FROM apps), " + _long_sql() + """,
med AS (SELECT column_name, QUANTILE_CONT(x, 0.5) AS med FROM l GROUP BY column_name),
f AS (SELECT l.column_name, domain, COALESCE(x, med, 0.0) AS xf, CAST(x IS NULL AS INTEGER) AS miss FROM l JOIN med USING (column_name)),
""" + _rename(auc_sql("f", ["column_name"], "xf", "domain"), 1) + ", " + _rename(auc_sql("f", ["column_name"], "miss", "domain"), 2) + """,
two AS (SELECT column_name, MIN(miss) <> MAX(miss) AS t FROM f GROUP BY column_name),
st AS (SELECT column_name, AVG(CASE WHEN domain = 0 THEN CAST(raw IS NULL AS DOUBLE) END) AS train_missing,
  AVG(CASE WHEN domain = 1 THEN CAST(raw IS NULL AS DOUBLE) END) AS test_missing,
  COUNT(DISTINCT CASE WHEN domain = 0 THEN raw END) AS train_nunique, COUNT(DISTINCT CASE WHEN domain = 1 THEN raw END) AS test_nunique FROM l GROUP BY column_name)
SELECT column_name, ROUND(GREATEST(auc1.roc_auc, 1 - auc1.roc_auc), 9) AS adv_auc_value,
  ROUND(CASE WHEN t THEN GREATEST(auc2.roc_auc, 1 - auc2.roc_auc) END, 9) AS adv_auc_missing,
  ROUND(train_missing, 9) AS train_missing, ROUND(test_missing, 9) AS test_missing, train_nunique, test_nunique
FROM auc1 JOIN auc2 USING (column_name) JOIN two USING (column_name) JOIN st USING (column_name)""")
def e24_univariate_drift_auc(spark, sf):
    tr, te = _pair(spark, sf)
    d = dr.univariate_drift(tr, te, DRIFT_COLS)
    return d.select("column_name", *[F.round(c, 9).alias(c) for c in ("adv_auc_value", "adv_auc_missing", "train_missing", "test_missing")],
                    "train_nunique", "test_nunique")


def _target_auc_sql(src: str) -> str:
    long = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, target_value, {c} AS x FROM {src} WHERE {c} IS NOT NULL" for c in NUM)
    return f"lt AS ({long}), " + auc_sql("lt", ["column_name"], "x")


@query("e25_univariate_target_auc", W("apps") + ", tr AS (SELECT * FROM apps WHERE is_test = 0), " + _target_auc_sql("tr") + """
SELECT column_name, ROUND(GREATEST(roc_auc, 1 - roc_auc), 9) AS auc, n_rows FROM auc WHERE n_rows >= 100 AND roc_auc IS NOT NULL""")
def e25_univariate_target_auc(spark, sf):
    tr, _ = _pair(spark, sf)
    a = dr.univariate_target_auc(tr, NUM, "target_value", 100)
    return a.select("column_name", F.round("auc", 9).alias("auc"), "n_rows")


@query("h06_top_k_features_by_auc", W("apps") + ", tr AS (SELECT * FROM apps WHERE is_test = 0 AND decision_day < DATE '2000-01-01'), " + _target_auc_sql("tr") + """
SELECT column_name, ROUND(auc, 9) AS auc FROM (SELECT column_name, GREATEST(roc_auc, 1 - roc_auc) AS auc FROM auc WHERE n_rows >= 100 AND roc_auc IS NOT NULL)
ORDER BY auc DESC, column_name LIMIT 2""")
def h06_top_k_features_by_auc(spark, sf):
    tr, _ = _pair(spark, sf)
    tr = tr.filter(F.col("decision_day") < F.lit("2000-01-01").cast("date"))
    top = dr.top_k_by_auc(dr.univariate_target_auc(tr, NUM, "target_value", 100), 2)
    return top.select("column_name", F.round("auc", 9).alias("auc"))


@query("e26_score_summary_by_label", W("scores") + """SELECT target_value, COUNT(*) AS n_rows, MIN(s2) AS min, ROUND(AVG(s2), 9) AS mean,
  ROUND(MEDIAN(s2), 9) AS median, MAX(s2) AS max FROM scores GROUP BY target_value""")
def e26_score_summary_by_label(spark, sf):
    s = dr.score_summary(fx.scores(spark, sf), "target_value", "s2")
    return s.select("target_value", "n_rows", "min", F.round("mean", 9).alias("mean"), F.round("median", 9).alias("median"), "max")


CORR_COLS = ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90", "target_value"]


@query("e28_correlation_matrix", W("apps") + ", tr AS (SELECT * FROM apps WHERE is_test = 0)\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) + 0e0 AS corr FROM tr"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))
def e28_correlation_matrix(spark, sf):
    tr, _ = _pair(spark, sf)
    cols = dr.present_columns(tr, CORR_COLS, 0.5, "target_value")
    m = dr.correlation_matrix(tr, cols)
    return m.select("a", "b", (F.round("corr", 6) + 0.0).alias("corr"))


def _hist_sql(src: str, col: str, side: str, bins: int) -> str:
    return f"""q AS (SELECT {side}, QUANTILE_CONT({col}, 0.01) AS lo, QUANTILE_CONT({col}, 0.99) AS hi FROM {src} GROUP BY {side}),
bd AS (SELECT MIN(lo) AS lo, MAX(hi) AS hi FROM q)
SELECT {side}, CAST(LEAST(FLOOR(({col} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, COUNT(*) AS n
FROM {src}, bd WHERE {col} IS NOT NULL AND {col} >= lo AND {col} <= hi GROUP BY ALL"""


@query("e32_density_histogram", W("apps") + ", " + _hist_sql("apps", "loan_amount_last", "is_test", 50))
def e32_density_histogram(spark, sf):
    return dr.density_histogram(fx.apps(spark, sf), "loan_amount_last", "is_test", 50)


def _class_hist_sql() -> str:
    """One histogram per numeric column and one of a constant column (a single bin)."""
    parts = [f"(WITH {_hist_sql('tr', c, 'target_value', 20)})".replace(
        "SELECT target_value, CAST(LEAST", f"SELECT '{c}' AS column_name, target_value, CAST(LEAST") for c in NUM]
    parts.append("(SELECT 'constant' AS column_name, target_value, 0 AS bin, COUNT(*) AS n FROM tr GROUP BY target_value)")
    return W("apps") + ", tr AS (SELECT * FROM apps WHERE is_test = 0)\n" + "\nUNION ALL ".join(f"SELECT column_name, target_value, bin, n FROM {p}" for p in parts)


@query("e33_class_histogram", _class_hist_sql())
def e33_class_histogram(spark, sf):
    tr, _ = _pair(spark, sf)
    tr = tr.withColumn("constant", F.lit(3.0))
    out = None
    for c in [*NUM, "constant"]:
        part = dr.density_histogram(tr, c, "target_value", 20).withColumn("column_name", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out.select("column_name", "target_value", "bin", "n")


@query("e38_drift_by_month", W("apps") + """SELECT strftime(decision_day, '%Y-%m') AS month, COUNT(*) AS n_rows, ROUND(AVG(target_value), 9) AS prevalence,
  ROUND(CORR(loan_amount_last, target_value), 6) + 0e0 AS corr_loan_amount_last, ROUND(CORR(cnt_30, target_value), 6) + 0e0 AS corr_cnt_30
FROM apps WHERE is_test = 0 GROUP BY 1""")
def e38_drift_by_month(spark, sf):
    tr, _ = _pair(spark, sf)
    d = dr.drift_by_month(tr, "decision_day", "target_value", ["loan_amount_last", "cnt_30"])
    return d.select("month", "n_rows", F.round("prevalence", 9).alias("prevalence"),
                    *[(F.round(c, 6) + 0.0).alias(c) for c in ("corr_loan_amount_last", "corr_cnt_30")])
