"""Checks for the data-quality profile, id sets, contracts, sorts and top-k
(B03, E01-E07, E09, F07-F09, G01, G05, G06, H01-H05, M02, M03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pf
from ..operators.ranks import join_back
from ..sources import fixtures as fx
from .catalog import query

W = fx.with_views
COLS = ["decision_day", "loan_amount_last", "balance_amt", "db_group_last", "fl_adminarea", "cnt_30", "cnt_90"]
NUM = ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90"]
FEATS = ["decision_day", "cust_id", "loan_amount_last", "balance_amt", "db_group_last", "fl_adminarea", "cnt_30", "cnt_90"]


def _pair(spark, sf):
    a = fx.apps(spark, sf)
    tr = a.filter("is_test = 0").drop("is_test")
    te = a.filter("is_test = 1").drop("is_test", "target_value")
    return tr, te


def _both(spark, sf):
    tr, te = _pair(spark, sf)
    return pf.tagged_union(tr, te)


def _per_col(template: str, cols) -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in cols)


@query("e01_class_counts", W("apps") + """SELECT target_value, COUNT(*) AS n_rows, COUNT(*) / (SELECT COUNT(*) FROM apps WHERE is_test = 0) AS share
FROM apps WHERE is_test = 0 GROUP BY target_value""")
def e01_class_counts(spark, sf):
    tr, _ = _pair(spark, sf)
    return pf.class_counts(tr, "target_value")


@query("e02_distinct_counts", W("apps") + _per_col(
    "SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) FILTER (WHERE is_test = 0) + MAX(CASE WHEN is_test = 0 AND {c} IS NULL THEN 1 ELSE 0 END) AS train_nunique, "
    "COUNT(DISTINCT {c}) FILTER (WHERE is_test = 1) + MAX(CASE WHEN is_test = 1 AND {c} IS NULL THEN 1 ELSE 0 END) AS test_nunique FROM apps", COLS))
def e02_distinct_counts(spark, sf):
    return pf.distinct_counts(_both(spark, sf), COLS)


@query("e03_h01_missingness_sorted", W("apps") + "SELECT * FROM (" + _per_col(
    "SELECT '{c}' AS column_name, AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 0) AS train_missing_rate, "
    "AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 1) AS test_missing_rate, "
    "AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 1) - AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 0) AS test_minus_train FROM apps",
    COLS) + ") ORDER BY ABS(test_minus_train) DESC, column_name")
def e03_h01_missingness_sorted(spark, sf):
    return pf.missing_rates(_both(spark, sf), COLS).orderBy(F.abs("test_minus_train").desc(), "column_name")


@query("e04_numeric_ranges", W("apps") + _per_col(
    "SELECT '{c}' AS column_name, MIN({c}) FILTER (WHERE is_test = 0) AS train_min, MAX({c}) FILTER (WHERE is_test = 0) AS train_max, "
    "ROUND(AVG({c}) FILTER (WHERE is_test = 0), 6) AS train_mean, ROUND(STDDEV_SAMP({c}) FILTER (WHERE is_test = 0), 6) AS train_std, "
    "MIN({c}) FILTER (WHERE is_test = 1) AS test_min, MAX({c}) FILTER (WHERE is_test = 1) AS test_max, "
    "ROUND(AVG({c}) FILTER (WHERE is_test = 1), 6) AS test_mean, ROUND(STDDEV_SAMP({c}) FILTER (WHERE is_test = 1), 6) AS test_std FROM apps",
    NUM))
def e04_numeric_ranges(spark, sf):
    r = pf.numeric_ranges(_both(spark, sf), NUM)
    for c in ("train_mean", "train_std", "test_mean", "test_std"):
        r = r.withColumn(c, F.round(c, 6))
    return r


@query("e05_date_profile", W("apps") + """, t AS (SELECT is_test AS side, CASE WHEN front_id % 101 = 0 THEN NULL WHEN front_id % 103 = 0 THEN 'n/a'
  ELSE CAST(decision_day AS VARCHAR) END AS raw FROM apps)
SELECT side, COUNT(*) FILTER (WHERE raw IS NULL) AS missing, COUNT(*) FILTER (WHERE raw IS NOT NULL AND TRY_CAST(raw AS DATE) IS NULL) AS parse_failures,
  COUNT(DISTINCT raw) + MAX(CASE WHEN raw IS NULL THEN 1 ELSE 0 END) AS nunique, MIN(TRY_CAST(raw AS DATE)) AS min, MAX(TRY_CAST(raw AS DATE)) AS max
FROM t GROUP BY side""")
def e05_date_profile(spark, sf):
    b = _both(spark, sf)
    fid = F.col("front_id")
    raw = F.when(fid % 101 == 0, F.lit(None).cast("string")).when(fid % 103 == 0, "n/a").otherwise(F.col("decision_day").cast("string"))
    return pf.date_profile(b.withColumn("day_text", raw), "day_text")


@query("e05_day_overlap", W("apps") + """, a AS (SELECT DISTINCT decision_day AS d FROM apps WHERE is_test = 0),
b AS (SELECT DISTINCT decision_day AS d FROM apps WHERE is_test = 1)
SELECT COUNT(*) FILTER (WHERE a.d IS NOT NULL AND b.d IS NOT NULL) AS shared_days, COUNT(*) FILTER (WHERE b.d IS NULL) AS train_only_days,
  COUNT(*) FILTER (WHERE a.d IS NULL) AS test_only_days FROM a FULL OUTER JOIN b ON a.d = b.d""")
def e05_day_overlap(spark, sf):
    return pf.day_overlap(_both(spark, sf), "decision_day")


@query("e06_monthly_rows_and_rate", W("apps") + """SELECT is_test AS side, strftime(decision_day, '%Y-%m') AS month, COUNT(*) AS rows,
  ROUND(AVG(CASE WHEN is_test = 0 THEN target_value END), 9) AS target_rate FROM apps GROUP BY ALL""")
def e06_monthly_rows_and_rate(spark, sf):
    return pf.monthly(_both(spark, sf), "decision_day", "target_value").withColumn("target_rate", F.round("target_rate", 9))


@query("e07_h03_category_prevalence_top15", W("apps") + """SELECT fl_adminarea, ROUND(rate, 9) AS rate, n_rows FROM (
  SELECT COALESCE(fl_adminarea, '__MISSING__') AS fl_adminarea, AVG(target_value) AS rate, COUNT(*) AS n_rows
  FROM apps WHERE is_test = 0 GROUP BY 1 ORDER BY rate DESC, fl_adminarea LIMIT 15)""")
def e07_h03_category_prevalence_top15(spark, sf):
    tr, _ = _pair(spark, sf)
    return pf.category_prevalence(tr, "fl_adminarea", "target_value", 15).withColumn("rate", F.round("rate", 9))


DUP_FEATS = ["db_group_last", "fl_adminarea", "cnt_30", "cnt_90"]


def _dup_sql(feats: list[str]) -> str:
    cols, same = ", ".join(feats), " AND ".join(f"gtr.{c} IS NOT DISTINCT FROM gte.{c}" for c in feats)
    return W("apps") + f""", tr AS (SELECT * EXCLUDE (is_test) FROM apps WHERE is_test = 0),
te AS (SELECT * EXCLUDE (is_test, target_value) FROM apps WHERE is_test = 1),
gtr AS (SELECT {cols}, COUNT(*) AS n, COUNT(DISTINCT target_value) AS k FROM tr GROUP BY {cols}),
gte AS (SELECT {cols}, COUNT(*) AS n FROM te GROUP BY {cols}),
sh AS (SELECT gtr.n AS ntr, gte.n AS nte FROM gtr JOIN gte ON {same})
SELECT (SELECT COUNT(*) - COUNT(DISTINCT tr) FROM tr) AS train_full_duplicate_rows,
  (SELECT COUNT(*) - COUNT(DISTINCT te) FROM te) AS test_full_duplicate_rows,
  (SELECT CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM gtr) AS train_duplicate_feature_rows,
  (SELECT COUNT(*) FILTER (WHERE n > 1 AND k > 1) FROM gtr) AS train_conflicting_groups,
  (SELECT CAST(COALESCE(SUM(n) FILTER (WHERE n > 1 AND k > 1), 0) AS BIGINT) FROM gtr) AS train_conflicting_rows,
  (SELECT CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM gte) AS test_duplicate_feature_rows,
  (SELECT COUNT(*) FROM sh) AS shared_signatures, (SELECT CAST(COALESCE(SUM(ntr), 0) AS BIGINT) FROM sh) AS train_rows_shared,
  (SELECT CAST(COALESCE(SUM(nte), 0) AS BIGINT) FROM sh) AS test_rows_shared"""


@query("e09_f07_duplicate_summary", _dup_sql(DUP_FEATS))
def e09_f07_duplicate_summary(spark, sf):
    tr, te = _pair(spark, sf)
    return pf.duplicate_summary(tr, te, DUP_FEATS, "target_value")


@query("e09_duplicates_on_all_features", _dup_sql(FEATS))
def e09_duplicates_on_all_features(spark, sf):
    tr, te = _pair(spark, sf)
    return pf.duplicate_summary(tr, te, FEATS, "target_value")


@query("f07_shared_signature_rows", W("apps") + """, te AS (SELECT DISTINCT db_group_last, fl_adminarea, cnt_30, cnt_90 FROM apps WHERE is_test = 1)
SELECT front_id FROM apps a WHERE is_test = 0 AND EXISTS (SELECT 1 FROM te WHERE te.db_group_last IS NOT DISTINCT FROM a.db_group_last
  AND te.fl_adminarea IS NOT DISTINCT FROM a.fl_adminarea AND te.cnt_30 IS NOT DISTINCT FROM a.cnt_30 AND te.cnt_90 IS NOT DISTINCT FROM a.cnt_90)""")
def f07_shared_signature_rows(spark, sf):
    tr, te = _pair(spark, sf)
    sig = te.select(*DUP_FEATS).distinct()
    return join_back(tr, sig, DUP_FEATS, how="left_semi").select("front_id")


SAMPLE_SQL = "sample AS (SELECT o_orderkey AS front_id, CAST(0.5 AS DOUBLE) AS target_value FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01')"


def _sample(spark, sf):
    from ..sources.tables import read_table
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return o.filter(F.to_date("o_orderdate") >= F.lit("2000-06-01").cast("date")).select(
        F.col("o_orderkey").alias("front_id"), F.lit(0.5).alias("target_value"))


@query("f08_id_set_report", W("apps") + ", " + SAMPLE_SQL + """, ids AS (SELECT front_id, 'train' AS s FROM apps WHERE is_test = 0
  UNION SELECT front_id, 'test' FROM apps WHERE is_test = 1 UNION SELECT front_id, 'sample' FROM sample),
per AS (SELECT front_id, BOOL_OR(s = 'train') AS in_train, BOOL_OR(s = 'test') AS in_test, BOOL_OR(s = 'sample') AS in_sample FROM ids GROUP BY front_id)
SELECT in_train, in_test, in_sample, COUNT(*) AS n_ids FROM per GROUP BY ALL""")
def f08_id_set_report(spark, sf):
    tr, te = _pair(spark, sf)
    return pf.id_set_report({"train": tr, "test": te, "sample": _sample(spark, sf)}, "front_id")


@query("f09_categorical_overlap", W("apps") + _per_col(
    "SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) FILTER (WHERE is_test = 0) AS train_nunique_non_null, "
    "COUNT(DISTINCT {c}) FILTER (WHERE is_test = 1) AS test_nunique_non_null, COUNT(*) FILTER (WHERE is_test = 0 AND {c} IS NULL) AS missing_train, "
    "COUNT(*) FILTER (WHERE is_test = 1 AND {c} IS NULL) AS missing_test, AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 0) AS missing_rate_train, "
    "AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 1) AS missing_rate_test, "
    "(SELECT COUNT(*) FROM (SELECT DISTINCT {c} FROM apps WHERE is_test = 1 AND {c} IS NOT NULL EXCEPT SELECT DISTINCT {c} FROM apps WHERE is_test = 0)) AS unseen_in_test_count, "
    "COALESCE((SELECT STRING_AGG(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM apps WHERE is_test = 1 AND {c} IS NOT NULL "
    "EXCEPT SELECT DISTINCT CAST({c} AS VARCHAR) FROM apps WHERE is_test = 0)), '') AS unseen_in_test_values FROM apps",
    ["db_group_last", "fl_adminarea", "cnt_90"]))
def f09_categorical_overlap(spark, sf):
    tr, te = _pair(spark, sf)
    return pf.categorical_overlap(tr, te, ["db_group_last", "fl_adminarea", "cnt_90"])


@query("m02_sample_status", W("apps") + ", " + SAMPLE_SQL + """, te AS (SELECT front_id FROM apps WHERE is_test = 1),
s_in AS (SELECT front_id, ROW_NUMBER() OVER (ORDER BY front_id) AS k FROM sample WHERE front_id IN (SELECT front_id FROM te)),
t_o AS (SELECT front_id, ROW_NUMBER() OVER (ORDER BY front_id) AS k FROM te),
x AS (SELECT (SELECT COUNT(*) FROM te WHERE front_id NOT IN (SELECT front_id FROM sample)) AS test_minus_sample_ids,
  (SELECT COUNT(DISTINCT front_id) FROM sample WHERE front_id NOT IN (SELECT front_id FROM te)) AS sample_minus_test_ids,
  (SELECT COUNT(*) FROM s_in JOIN t_o USING (k, front_id)) = (SELECT COUNT(DISTINCT front_id) FROM te)
   AND (SELECT COUNT(*) FROM s_in) = (SELECT COUNT(DISTINCT front_id) FROM te) AS same_order)
SELECT *, CASE WHEN test_minus_sample_ids = 0 AND same_order AND sample_minus_test_ids = 0 THEN 'PASS_SAMPLE_MATCHES_TEST'
  WHEN test_minus_sample_ids = 0 AND same_order THEN 'HOLD_SAMPLE_CONTAINS_EXTRA_IDS_BUT_TEST_BLOCK_IS_ALIGNED'
  ELSE 'BLOCK_SAMPLE_TEST_MAPPING_UNCLEAR' END AS status FROM x""")
def m02_sample_status(spark, sf):
    _, te = _pair(spark, sf)
    s = _sample(spark, sf).withColumn("pos", F.col("front_id"))
    return pf.sample_status(te.withColumn("pos", F.col("front_id")), s, "front_id")


@query("h05_ordered_id_equality", W("apps") + ", " + SAMPLE_SQL + """, a AS (SELECT front_id, ROW_NUMBER() OVER (ORDER BY front_id) AS pos FROM apps WHERE is_test = 1),
b AS (SELECT front_id, ROW_NUMBER() OVER (ORDER BY front_id) AS pos FROM sample WHERE front_id IN (SELECT front_id FROM a))
SELECT (SELECT COUNT(*) FROM a JOIN b USING (pos, front_id)) AS matched, (SELECT COUNT(*) FROM a) AS n_a, (SELECT COUNT(*) FROM b) AS n_b,
  (SELECT COUNT(*) FROM a JOIN b USING (pos, front_id)) = (SELECT COUNT(*) FROM a) AND (SELECT COUNT(*) FROM a) = (SELECT COUNT(*) FROM b) AS same_order""")
def h05_ordered_id_equality(spark, sf):
    from ..operators.ranks import prefix_sums
    _, te = _pair(spark, sf)
    s = _sample(spark, sf).join(te.select("front_id"), "front_id", "left_semi")

    def pos(df):
        p = prefix_sums(df.select("front_id").withColumn("__one", F.lit(1)), [], ["front_id"], ["__one"])
        return p.select("front_id", (F.col("__one_before") + 1).alias("pos"))
    return pf.ordered_equal(pos(te), pos(s), "front_id")


@query("m03_target_contract", W("apps") + """SELECT * FROM (VALUES ('target_in_train', TRUE, ''), ('target_not_in_test', TRUE, '')) t(check_name, passed, detail)
UNION ALL SELECT 'target_values_binary', list_sort(list(DISTINCT CAST(target_value AS VARCHAR))) = ['0', '1'],
  array_to_string(list_sort(list(DISTINCT CAST(target_value AS VARCHAR))), ',') FROM apps WHERE is_test = 0""")
def m03_target_contract(spark, sf):
    from ..operators.schema import check_target
    tr, te = _pair(spark, sf)
    return check_target(tr, te, "target_value").withColumnRenamed("check", "check_name")


@query("b03_schema_report", W("apps") + _per_col(
    "SELECT '{c}' AS column_name, AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 0) AS train_missing_rate, "
    "AVG(CAST({c} IS NULL AS DOUBLE)) FILTER (WHERE is_test = 1) AS test_missing_rate, "
    "COUNT(DISTINCT {c}) FILTER (WHERE is_test = 0) + MAX(CASE WHEN is_test = 0 AND {c} IS NULL THEN 1 ELSE 0 END) AS train_nunique, "
    "COUNT(DISTINCT {c}) FILTER (WHERE is_test = 1) + MAX(CASE WHEN is_test = 1 AND {c} IS NULL THEN 1 ELSE 0 END) AS test_nunique FROM apps",
    FEATS).join(["SELECT column_name, role_initial, in_train, in_test, train_dtype, test_dtype, train_missing_rate, test_missing_rate, train_nunique, test_nunique FROM (",
    """) JOIN (VALUES ('decision_day', 'date_grouping_feature_candidate', TRUE, TRUE, 'date', 'date'),
  ('loan_amount_last', 'numeric_feature_candidate', TRUE, TRUE, 'double', 'double'), ('balance_amt', 'numeric_feature_candidate', TRUE, TRUE, 'double', 'double'),
  ('db_group_last', 'categorical_feature', TRUE, TRUE, 'string', 'string'), ('fl_adminarea', 'categorical_feature', TRUE, TRUE, 'string', 'string'),
  ('cnt_30', 'numeric_feature_candidate', TRUE, TRUE, 'double', 'double'), ('cnt_90', 'numeric_feature_candidate', TRUE, TRUE, 'double', 'double'))
  t(column_name, role_initial, in_train, in_test, train_dtype, test_dtype) USING (column_name)
UNION ALL SELECT 'front_id', 'id_excluded', TRUE, TRUE, 'bigint', 'bigint', 0e0, 0e0, COUNT(DISTINCT front_id) FILTER (WHERE is_test = 0), COUNT(DISTINCT front_id) FILTER (WHERE is_test = 1) FROM apps
UNION ALL SELECT 'cust_id', 'numeric_feature_candidate', TRUE, TRUE, 'bigint', 'bigint', 0e0, 0e0, COUNT(DISTINCT cust_id) FILTER (WHERE is_test = 0), COUNT(DISTINCT cust_id) FILTER (WHERE is_test = 1) FROM apps
UNION ALL SELECT 'target_value', 'target', TRUE, FALSE, 'int', '', 0e0, 1e0, COUNT(DISTINCT target_value) FILTER (WHERE is_test = 0), 1 FROM apps"""]))
def b03_schema_report(spark, sf):
    tr, te = _pair(spark, sf)
    roles = {"front_id": "id_excluded", "target_value": "target", "decision_day": "date_grouping_feature_candidate",
             "db_group_last": "categorical_feature", "fl_adminarea": "categorical_feature"}
    return pf.schema_report(tr, te, roles, "front_id", "target_value")


@query("g01_tagged_union", W("apps") + """SELECT side, COUNT(*) AS n_rows, COUNT(target_value) AS n_target FROM (
  SELECT 0 AS side, target_value FROM apps WHERE is_test = 0 UNION ALL SELECT 1, NULL FROM apps WHERE is_test = 1) GROUP BY side""")
def g01_tagged_union(spark, sf):
    b = _both(spark, sf)
    return b.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.count("target_value").alias("n_target"))


@query("g05_duplicate_members", W("offers") + """SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_copies,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, overdraft_limit_max) > 1 AS after_first
FROM offers QUALIFY COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def g05_duplicate_members(spark, sf):
    from ..operators.reshape import duplicate_members
    o = fx.offers(spark, sf)
    return duplicate_members(o, ["l_orderkey", "l_linenumber"], ["l_partkey", "overdraft_limit_max"]).select(
        "l_orderkey", "l_linenumber", "n_copies", "after_first")


@query("g06_wide_to_long", W("apps") + """SELECT front_id, column_name, value FROM (
  SELECT front_id, 'loan_amount_last' AS column_name, loan_amount_last AS value FROM apps UNION ALL
  SELECT front_id, 'balance_amt', balance_amt FROM apps UNION ALL SELECT front_id, 'cnt_30', cnt_30 FROM apps UNION ALL
  SELECT front_id, 'cnt_90', cnt_90 FROM apps)""")
def g06_wide_to_long(spark, sf):
    from ..operators.reshape import wide_to_long
    return wide_to_long(fx.apps(spark, sf), ["front_id"], NUM, "column_name", "value")


@query("h02_multi_key_sort_nulls_last", W("apps") + """SELECT front_id, balance_amt, cnt_90 FROM apps
ORDER BY balance_amt DESC NULLS LAST, cnt_90 ASC NULLS LAST, front_id""")
def h02_multi_key_sort_nulls_last(spark, sf):
    a = fx.apps(spark, sf)
    return a.select("front_id", "balance_amt", "cnt_90").orderBy(F.desc_nulls_last("balance_amt"), F.asc_nulls_last("cnt_90"), "front_id")


@query("h04_best_row_by_tuple", W("apps") + """SELECT fl_adminarea, n_rows, ROUND(rate, 9) AS rate FROM (
  SELECT fl_adminarea, COUNT(*) AS n_rows, AVG(target_value) AS rate FROM apps WHERE is_test = 0 GROUP BY 1)
ORDER BY rate DESC, n_rows DESC, fl_adminarea LIMIT 1""")
def h04_best_row_by_tuple(spark, sf):
    tr, _ = _pair(spark, sf)
    g = tr.groupBy("fl_adminarea").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("target_value").alias("rate"))
    # Best (rate, rows), ties by the smallest name: each task keeps one row.
    return g.orderBy(F.desc("rate"), F.desc("n_rows"), "fl_adminarea").limit(1).select("fl_adminarea", "n_rows", F.round("rate", 9).alias("rate"))
