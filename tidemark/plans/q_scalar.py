"""Checks for scalar functions, schema rules and sample weights
(B01, B05, B08, B09, B12, C01-C29, J01-J08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import categorical as cat
from ..functions import scalar as sc
from ..operators import weights as wt
from ..operators.ranks import dense_index
from ..sources import fixtures as fx
from .catalog import query

W = fx.with_views
TR = "tr AS (SELECT * FROM apps WHERE is_test = 0)"

# Paired-feature spec for the apps fixture (same shape as the reference's
# spec list; the duplicate entry checks that a name is produced once).
APPS_PAIRED = [
    ("loan_minus_balance", "loan_amount_last", "balance_amt", "diff"),
    ("cnt_30_to_90", "cnt_30", "cnt_90", "ratio"),
    ("balance_to_loan_amount", "balance_amt", "loan_amount_last", "ratio"),
    ("cnt_30_to_90", "cnt_30", "cnt_90", "ratio"),
    ("absent_ratio", "no_such_column", "cnt_90", "ratio"),
]


def _apps(spark, sf):
    return fx.apps(spark, sf)


def _train(spark, sf):
    return fx.train_apps(spark, sf)


@query("c01_safe_ratio", W("apps") + """SELECT front_id,
  CASE WHEN ABS(cnt_90) > 1e-9 THEN cnt_30 / cnt_90 END AS cnt_30_to_90,
  CASE WHEN ABS(loan_amount_last) > 1e-12 THEN balance_amt / loan_amount_last END AS balance_to_loan_amount,
  CASE WHEN ABS(TRY_CAST(CAST(cnt_90 AS VARCHAR) || CASE WHEN front_id % 3 = 0 THEN 'x' ELSE '' END AS DOUBLE)) > 1e-9
       THEN cnt_30 / TRY_CAST(CAST(cnt_90 AS VARCHAR) || CASE WHEN front_id % 3 = 0 THEN 'x' ELSE '' END AS DOUBLE) END AS text_ratio
FROM apps""")
def c01_safe_ratio(spark, sf):
    a = _apps(spark, sf)
    text = F.concat(F.col("cnt_90").cast("string"), F.when(F.col("front_id") % 3 == 0, "x").otherwise(""))
    a = a.withColumn("cnt_90_text", text)
    return a.select(
        "front_id",
        sc.safe_divide("cnt_30", "cnt_90").alias("cnt_30_to_90"),
        sc.safe_divide("balance_amt", "loan_amount_last", sc.EPS_FOLDSAFE).alias("balance_to_loan_amount"),
        sc.safe_divide("cnt_30", "cnt_90_text").alias("text_ratio"),
    )


@query("c02_paired_features", W("apps") + """SELECT front_id,
  loan_amount_last - balance_amt AS loan_minus_balance,
  CASE WHEN ABS(cnt_90) > 1e-9 THEN cnt_30 / cnt_90 END AS cnt_30_to_90,
  CASE WHEN ABS(loan_amount_last) > 1e-9 THEN balance_amt / loan_amount_last END AS balance_to_loan_amount
FROM apps""")
def c02_paired_features(spark, sf):
    a = _apps(spark, sf)
    return a.select("front_id", *sc.paired_features(a.columns, APPS_PAIRED))


# Every column of the two fixed spec lists, made from the id with missing
# values and zeros (column i: missing when id % (i + 3) = 0, else id % (i + 7) - 2).
SPEC_COLUMNS = sorted({c for spec in sc.RATE_LIMIT_SPECS + sc.ACTIVITY_SPECS for c in spec[1:3]})
SPEC_SQL = ", ".join(f"CASE WHEN front_id % {i + 3} = 0 THEN NULL ELSE CAST(front_id % {i + 7} - 2 AS DOUBLE) END AS {c}"
                     for i, c in enumerate(SPEC_COLUMNS))


@query("c02_fixed_pair_specs", W("apps") + f", w AS (SELECT front_id, {SPEC_SQL} FROM apps)\nSELECT front_id, " + ", ".join(
    f"{a} - {b} AS {n}" if op == "diff" else f"CASE WHEN ABS({b}) > 1e-9 THEN {a} / {b} END AS {n}"
    for n, a, b, op in sc.RATE_LIMIT_SPECS + sc.ACTIVITY_SPECS) + " FROM w")
def c02_fixed_pair_specs(spark, sf):
    fid = F.col("front_id")
    w = _apps(spark, sf).select("front_id", *[
        F.when(fid % (i + 3) != 0, (fid % (i + 7) - 2).cast("double")).alias(c) for i, c in enumerate(SPEC_COLUMNS)])
    return w.select("front_id", *sc.paired_features(w.columns, sc.RATE_LIMIT_SPECS + sc.ACTIVITY_SPECS))


@query("c03_limit_midpoint", W("offers") + """SELECT l_orderkey, l_linenumber, l_partkey,
  (overdraft_limit_min + overdraft_limit_max) / 2.0 AS overdraft_limit_mid,
  CASE WHEN ABS((overdraft_limit_min + overdraft_limit_max) / 2.0) > 1e-9
       THEN offered_rate / ((overdraft_limit_min + overdraft_limit_max) / 2.0) END AS rate_to_limit_mid
FROM offers""")
def c03_limit_midpoint(spark, sf):
    o = fx.offers(spark, sf)
    return o.select("l_orderkey", "l_linenumber", "l_partkey",
                    *sc.midpoint_features("overdraft_limit_min", "overdraft_limit_max", "offered_rate",
                                          ratio_name="rate_to_limit_mid"))


@query("c04_infinite_to_missing", W("apps") + """, x AS (SELECT front_id, CASE WHEN cnt_30 = 0 THEN CAST('Infinity' AS DOUBLE)
  WHEN cnt_30 = 1 THEN CAST('-Infinity' AS DOUBLE) ELSE loan_amount_last / cnt_30 END AS v FROM apps)
SELECT front_id, CASE WHEN isinf(v) OR isnan(v) THEN NULL ELSE v END AS v_finite FROM x""")
def c04_infinite_to_missing(spark, sf):
    a = _apps(spark, sf)
    v = (F.when(F.col("cnt_30") == 0, F.lit(float("inf")))
         .when(F.col("cnt_30") == 1, F.lit(float("-inf")))
         .otherwise(F.col("loan_amount_last") / F.col("cnt_30")))
    return a.select("front_id", sc.finite(v).alias("v_finite"))


@query("c05_signed_log", W("apps") + """SELECT front_id,
  ROUND(SIGN(balance_amt) * LN(1 + ABS(balance_amt)), 6) AS balance_amt_slog,
  ROUND(SIGN(loan_amount_last) * LN(1 + ABS(loan_amount_last)), 6) AS loan_amount_last_slog
FROM apps""")
def c05_signed_log(spark, sf):
    a = _apps(spark, sf)
    return a.select("front_id", F.round(sc.signed_log1p("balance_amt"), 6).alias("balance_amt_slog"),
                    F.round(sc.signed_log1p("loan_amount_last"), 6).alias("loan_amount_last_slog"))


@query("c06_zero_flags", W("apps") + """SELECT front_id, COALESCE(CAST(cnt_30 = 0 AS INTEGER), 0) AS cnt_30_is_zero,
  COALESCE(CAST(cnt_90 = 0 AS INTEGER), 0) AS cnt_90_is_zero FROM apps""")
def c06_zero_flags(spark, sf):
    a = _apps(spark, sf)
    return a.select("front_id", sc.zero_flag("cnt_30").alias("cnt_30_is_zero"), sc.zero_flag("cnt_90").alias("cnt_90_is_zero"))


@query("c07_missing_count", W("apps") + """SELECT front_id, CAST(balance_amt IS NULL AS INTEGER) + CAST(db_group_last IS NULL AS INTEGER)
  + CAST(cnt_90 IS NULL AS INTEGER) + CAST(loan_amount_last IS NULL AS INTEGER) AS n_missing FROM apps""")
def c07_missing_count(spark, sf):
    a = _apps(spark, sf)
    return a.select("front_id", sc.missing_count(["balance_amt", "db_group_last", "cnt_90", "loan_amount_last"]).alias("n_missing"))


@query("c08_missing_flags", W("apps") + """SELECT front_id, CAST(balance_amt IS NULL AS INTEGER) AS balance_amt_is_missing,
  CAST(cnt_90 IS NULL AS INTEGER) AS cnt_90_is_missing FROM apps""")
def c08_missing_flags(spark, sf):
    a = _apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1")
    cols = sc.missing_flag_columns([tr, te], ["loan_amount_last", "balance_amt", "cnt_30", "cnt_90"])
    return a.select("front_id", *[sc.missing_flag(c) for c in cols])


@query("c09_clip", W("scores") + """, x AS (SELECT front_id, CASE WHEN front_id % 6 = 0 THEN NULL ELSE s1 END AS s1, s2 FROM scores)
SELECT front_id, CASE WHEN s1 IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, s1 * 1.5 - 0.2)) END AS s1_clipped,
  GREATEST(0.05, LEAST(0.95, s2)) AS s2_clipped FROM x""")
def c09_clip(spark, sf):
    s = fx.scores(spark, sf).withColumn("s1", F.when(F.col("front_id") % 6 != 0, F.col("s1")))
    return s.select("front_id", sc.clip(F.col("s1") * 1.5 - 0.2, 0.0, 1.0).alias("s1_clipped"),
                    sc.clip("s2", 0.05, 0.95).alias("s2_clipped"))


@query("c10_standardize", W("apps") + ", " + TR + """,
st AS (SELECT AVG(loan_amount_last) AS m1, STDDEV_SAMP(loan_amount_last) AS s1, AVG(balance_amt) AS m2, STDDEV_SAMP(balance_amt) AS s2 FROM tr)
SELECT front_id,
  ROUND(GREATEST(-10.0, LEAST(10.0, (loan_amount_last - m1) / CASE WHEN s1 IS NULL OR s1 = 0 THEN 1.0 ELSE s1 END)), 6) AS loan_amount_last_z,
  CASE WHEN balance_amt IS NOT NULL THEN ROUND(GREATEST(-10.0, LEAST(10.0, (balance_amt - m2) / CASE WHEN s2 IS NULL OR s2 = 0 THEN 1.0 ELSE s2 END)), 6) END AS balance_amt_z
FROM apps, st""")
def c10_standardize(spark, sf):
    a, tr = _apps(spark, sf), _train(spark, sf)
    return a.select("front_id", F.round(sc.standardize(tr, "loan_amount_last"), 6).alias("loan_amount_last_z"),
                    F.round(sc.standardize(tr, "balance_amt"), 6).alias("balance_amt_z"))


@query("c11_median_fill", W("apps") + ", " + TR + """
SELECT front_id, ROUND(COALESCE(balance_amt, (SELECT MEDIAN(balance_amt) FROM tr), 0.0), 6) AS balance_amt_filled,
  ROUND(COALESCE(cnt_90, (SELECT MEDIAN(cnt_90) FROM tr), 0.0), 6) AS cnt_90_filled FROM apps""")
def c11_median_fill(spark, sf):
    a, tr = _apps(spark, sf), _train(spark, sf)
    return a.select("front_id", F.round(sc.median_fill(tr, "balance_amt"), 6).alias("balance_amt_filled"),
                    F.round(sc.median_fill(tr, "cnt_90"), 6).alias("cnt_90_filled"))


@query("c12_date_parse", W("apps") + """, t AS (SELECT front_id, CASE WHEN front_id % 3 = 0 THEN 'day ' || CAST(decision_day AS VARCHAR)
  ELSE CAST(decision_day AS VARCHAR) END AS day_text FROM apps)
SELECT t.front_id, TRY_CAST(day_text AS DATE) AS day_lenient, decision_day AS day_strict FROM t JOIN apps USING (front_id)""")
def c12_date_parse(spark, sf):
    a = _apps(spark, sf)
    t = a.select("front_id", F.when(F.col("front_id") % 3 == 0, F.concat(F.lit("day "), F.col("decision_day").cast("string")))
                 .otherwise(F.col("decision_day").cast("string")).alias("day_text"), F.col("decision_day").cast("string").alias("clean"))
    return t.select("front_id", cal.parse_day("day_text", strict=False).alias("day_lenient"), cal.parse_day("clean").alias("day_strict"))


@query("c13_day_number", W("apps") + ", " + TR + """
SELECT front_id, CAST(date_diff('day', (SELECT MIN(decision_day) FROM tr), decision_day) AS INTEGER) AS day_num FROM apps""")
def c13_day_number(spark, sf):
    a, tr = _apps(spark, sf), _train(spark, sf)
    return a.select("front_id", cal.day_number("decision_day", tr).alias("day_num"))


@query("c14_c16_calendar_parts", W("apps") + """SELECT front_id, strftime(decision_day, '%Y-%m') AS month,
  CAST(isodow(decision_day) - 1 AS INTEGER) AS dow, CAST(weekofyear(decision_day) AS INTEGER) AS week FROM apps""")
def c14_c16_calendar_parts(spark, sf):
    a = _apps(spark, sf)
    return a.select("front_id", cal.year_month("decision_day").alias("month"), cal.weekday0("decision_day").alias("dow"),
                    cal.iso_week("decision_day").alias("week"))


@query("c17_cyclic_season", W("apps") + """SELECT front_id,
  ROUND(SIN(2 * PI() * dayofyear(decision_day) / 365.25), 6) + 0e0 AS doy_sin, ROUND(COS(2 * PI() * dayofyear(decision_day) / 365.25), 6) + 0e0 AS doy_cos,
  ROUND(SIN(2 * PI() * weekofyear(decision_day) / 52.0), 6) + 0e0 AS woy_sin, ROUND(COS(2 * PI() * weekofyear(decision_day) / 52.0), 6) + 0e0 AS woy_cos
FROM apps""")
def c17_cyclic_season(spark, sf):
    a = _apps(spark, sf)
    return a.select("front_id",
                    *[(F.round(e, 6) + 0.0).alias(n) for e, n in zip(cal.cyclic("decision_day"), ["doy_sin", "doy_cos", "woy_sin", "woy_cos"])])


@query("c18_day_ordinal", W("apps") + """SELECT front_id, CAST(date_diff('day', DATE '1970-01-01', decision_day) AS INTEGER) AS day_ord FROM apps""")
def c18_day_ordinal(spark, sf):
    return _apps(spark, sf).select("front_id", cal.ordinal("decision_day").alias("day_ord"))


@query("c19_day_group_key", W("apps") + """SELECT decision_day, COUNT(*) AS n_rows, CAST(SUM(target_value) AS BIGINT) AS n_pos
FROM apps WHERE is_test = 0 GROUP BY decision_day""")
def c19_day_group_key(spark, sf):
    return _train(spark, sf).groupBy("decision_day").agg(F.count(F.lit(1)).alias("n_rows"),
                                                         F.sum("target_value").cast("long").alias("n_pos"))


@query("c20_category_normalize", W("apps") + """SELECT COALESCE(db_group_last, '__MISSING__') AS db_group_last, COUNT(*) AS n_rows
FROM apps GROUP BY 1""")
def c20_category_normalize(spark, sf):
    return _apps(spark, sf).groupBy(cat.normalize("db_group_last").alias("db_group_last")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("c21_category_cross", W("apps") + """SELECT COALESCE(db_group_last, '__MISSING__') || '__' || COALESCE(fl_adminarea, '__MISSING__') AS seg_x_area,
  COUNT(*) AS n_rows FROM apps GROUP BY 1""")
def c21_category_cross(spark, sf):
    return _apps(spark, sf).groupBy(cat.cross("db_group_last", "fl_adminarea").alias("seg_x_area")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("c22_row_signature_groups", W("apps") + """SELECT db_group_last, cnt_90, cnt_30, COUNT(*) AS n_rows,
  COUNT(DISTINCT target_value) AS n_targets FROM apps GROUP BY db_group_last, cnt_90, cnt_30""")
def c22_row_signature_groups(spark, sf):
    # Grouping by the columns themselves: null-safe and collision-free.
    return _apps(spark, sf).groupBy("db_group_last", "cnt_90", "cnt_30").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("target_value").alias("n_targets"))


@query("c23_shared_dictionary", W("apps") + """SELECT fl_adminarea, CAST(DENSE_RANK() OVER (ORDER BY fl_adminarea) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT fl_adminarea FROM apps WHERE fl_adminarea IS NOT NULL)""")
def c23_shared_dictionary(spark, sf):
    a = _apps(spark, sf)
    return cat.dictionary([a.filter("is_test = 0"), a.filter("is_test = 1")], "fl_adminarea", "code")


@query("c24_ordinal_encode", W("apps") + """, d1 AS (SELECT db_group_last AS v, DENSE_RANK() OVER (ORDER BY db_group_last) - 1 AS code
  FROM (SELECT DISTINCT db_group_last FROM apps WHERE db_group_last IS NOT NULL)),
d2 AS (SELECT fl_adminarea AS v, DENSE_RANK() OVER (ORDER BY fl_adminarea) - 1 AS code
  FROM (SELECT DISTINCT fl_adminarea FROM apps WHERE is_test = 0 AND fl_adminarea < 'M'))
SELECT front_id, CAST(CASE WHEN db_group_last IS NULL THEN -2 ELSE COALESCE(d1.code, -1) END AS INTEGER) AS db_group_code,
  CAST(CASE WHEN fl_adminarea IS NULL THEN -1 ELSE COALESCE(d2.code, -1) END AS INTEGER) AS area_code
FROM apps LEFT JOIN d1 ON apps.db_group_last = d1.v LEFT JOIN d2 ON apps.fl_adminarea = d2.v""")
def c24_ordinal_encode(spark, sf):
    # db_group_last: dictionary over train + test, missing -> -2.
    # fl_adminarea: dictionary over the train rows of the first half of the
    # alphabet, so the other areas are unseen (-1) and missing is unseen too.
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1")
    out = cat.ordinal_encode(a, [tr, te], "db_group_last", "db_group_code")
    fit = tr.filter(F.col("fl_adminarea") < "M")
    out = cat.ordinal_encode(out, [fit], "fl_adminarea", "area_code", missing=None)
    return out.select("front_id", "db_group_code", "area_code")


@query("c25_train_codes", W("apps") + """, d AS (SELECT v, DENSE_RANK() OVER (ORDER BY v) AS code
  FROM (SELECT DISTINCT COALESCE(fl_adminarea, '__MISSING__') AS v FROM apps WHERE decision_day < DATE '1999-01-01'))
SELECT front_id, CAST(COALESCE(code, 0) AS INTEGER) AS area_code FROM apps LEFT JOIN d ON COALESCE(apps.fl_adminarea, '__MISSING__') = d.v""")
def c25_train_codes(spark, sf):
    a = _apps(spark, sf)
    fit = a.filter(F.col("decision_day") < F.lit("1999-01-01").cast("date"))
    return cat.train_codes(a, fit, "fl_adminarea", "area_code").select("front_id", "area_code")


@query("c26_day_group_id", W("apps") + """SELECT front_id, CAST(DENSE_RANK() OVER (ORDER BY decision_day) - 1 AS INTEGER) AS day_id
FROM apps WHERE is_test = 0""")
def c26_day_group_id(spark, sf):
    return dense_index(_train(spark, sf), "decision_day", "day_id").select("front_id", "day_id")


@query("c28_sorted_value_list", W("apps") + """SELECT COALESCE(db_group_last, '__MISSING__') AS segment,
  array_to_string(list_sort(list_distinct(list(fl_adminarea))), '|') AS areas FROM apps GROUP BY 1""")
def c28_sorted_value_list(spark, sf):
    return _apps(spark, sf).groupBy(cat.normalize("db_group_last").alias("segment")).agg(
        cat.sorted_joined("fl_adminarea").alias("areas"))


@query("c29_quantile_bounds", W("apps") + """SELECT is_test, ROUND(QUANTILE_CONT(loan_amount_last, 0.01), 6) AS p_lo,
  ROUND(QUANTILE_CONT(loan_amount_last, 0.99), 6) AS p_hi FROM apps GROUP BY is_test""")
def c29_quantile_bounds(spark, sf):
    from ..operators.drift import exact_quantiles
    q = exact_quantiles(_apps(spark, sf), ["is_test"], "loan_amount_last", [0.01, 0.99])
    pick = lambda p: F.round(F.max(F.when(F.col("q") == p, F.col("quantile"))), 6)
    return q.groupBy("is_test").agg(pick(0.01).alias("p_lo"), pick(0.99).alias("p_hi"))


@query("c29_whole_column_bounds", W("apps") + """SELECT ROUND(QUANTILE_CONT(balance_amt, 0.01), 6) AS p_lo, ROUND(QUANTILE_CONT(balance_amt, 0.99), 6) AS p_hi FROM apps""")
def c29_whole_column_bounds(spark, sf):
    return sc.quantile_bounds(_apps(spark, sf), "balance_amt").select(F.round("p_lo", 6).alias("p_lo"), F.round("p_hi", 6).alias("p_hi"))


# Schema rules ----------------------------------------------------------------

@query("b01_drop_non_features", W("apps") + """SELECT loan_amount_last, balance_amt, db_group_last, fl_adminarea, cnt_30, cnt_90
FROM apps WHERE is_test = 0""")
def b01_drop_non_features(spark, sf):
    from ..operators.schema import feature_frame
    return feature_frame(_train(spark, sf), id_col="front_id", target="target_value",
                         drop=["decision_day", "is_test", "cust_id"])


@query("b05_numeric_columns", W("apps") + """SELECT front_id, cust_id, loan_amount_last, balance_amt, cnt_30, cnt_90, target_value, is_test FROM apps""")
def b05_numeric_columns(spark, sf):
    from ..operators.schema import numeric_columns
    a = _apps(spark, sf)
    return a.select(*numeric_columns(a))


@query("b08_confidence_filter", W("scores") + """SELECT front_id, CAST(s1 > 0.5 AS INTEGER) AS pseudo_target FROM scores WHERE s1 > 0.9 OR s1 < 0.05""")
def b08_confidence_filter(spark, sf):
    from ..operators.schema import confident_rows
    return confident_rows(fx.scores(spark, sf), "s1", 0.9, 0.05).select("front_id", "pseudo_target")


@query("b09_usable_columns", W("apps") + """, tr AS (SELECT * FROM apps WHERE is_test = 0),
l AS (SELECT 'balance_amt' AS column_name, balance_amt AS x, target_value FROM tr UNION ALL
      SELECT 'cnt_90', cnt_90, target_value FROM tr UNION ALL SELECT 'cnt_30', cnt_30, target_value FROM tr UNION ALL
      SELECT 'loan_amount_last', loan_amount_last, target_value FROM tr)
SELECT column_name, COUNT(x) AS n_present FROM l WHERE x IS NOT NULL GROUP BY column_name
HAVING COUNT(x) >= 100 AND COUNT(DISTINCT target_value) = 2""")
def b09_usable_columns(spark, sf):
    from ..operators.schema import usable_columns
    return usable_columns(_train(spark, sf), ["balance_amt", "cnt_90", "cnt_30", "loan_amount_last"], "target_value", 100)


@query("b12_calendar_variant", W("apps") + ", " + TR + """, v(variant, d, m, w) AS (VALUES ('time_all', TRUE, TRUE, TRUE),
  ('day_num_only', TRUE, FALSE, FALSE), ('month_only', FALSE, TRUE, FALSE), ('week_only', FALSE, FALSE, TRUE),
  ('no_day_num', FALSE, TRUE, TRUE), ('no_month', TRUE, FALSE, TRUE), ('no_week', TRUE, TRUE, FALSE))
SELECT variant, front_id, CASE WHEN d THEN CAST(date_diff('day', (SELECT MIN(decision_day) FROM tr), decision_day) AS INTEGER) END AS day_num,
  CASE WHEN m THEN strftime(decision_day, '%Y-%m') END AS month, CASE WHEN w THEN CAST(weekofyear(decision_day) AS INTEGER) END AS week
FROM apps CROSS JOIN v""")
def b12_calendar_variant(spark, sf):
    a, tr = _apps(spark, sf), _train(spark, sf)
    out = None
    for variant in cal.CALENDAR_VARIANTS:
        part = a.select(F.lit(variant).alias("variant"), "front_id", *cal.calendar_columns("decision_day", tr, variant))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# Sample weights --------------------------------------------------------------

@query("j01_linear_recency", W("apps") + ", " + TR + """, b AS (SELECT MIN(decision_day) AS lo, MAX(decision_day) AS hi FROM tr)
SELECT front_id, ROUND(0.5 + CAST(date_diff('day', lo, decision_day) AS DOUBLE) / GREATEST(date_diff('day', lo, hi), 1) * 1.0, 9) AS w
FROM tr, b""")
def j01_linear_recency(spark, sf):
    tr = _train(spark, sf)
    return tr.select("front_id", F.round(wt.linear_recency(tr, "decision_day", 0.5, 1.5), 9).alias("w"))


@query("j02_exponential_recency", W("apps") + ", " + TR + """
SELECT front_id, ROUND(GREATEST(POW(0.5, CAST(date_diff('day', decision_day, (SELECT MAX(decision_day) FROM tr)) AS DOUBLE) / 120.0), 0.25), 9) AS w
FROM tr""")
def j02_exponential_recency(spark, sf):
    tr = _train(spark, sf)
    return tr.select("front_id", F.round(wt.exponential_recency(tr, "decision_day", 120.0, 0.25), 9).alias("w"))


@query("j03_recent_boost", W("apps") + ", " + TR + """
SELECT front_id, CASE WHEN decision_day >= DATE '2000-01-01' THEN 2e0 ELSE 1e0 END AS w FROM tr""")
def j03_recent_boost(spark, sf):
    tr = _train(spark, sf)
    return tr.select("front_id", wt.recent_boost("decision_day", "2000-01-01", 2.0, 1.0).alias("w"))


@query("j04_weights_from_table", W("apps") + ", " + TR + """
SELECT front_id, CAST(cnt_30 + 1 AS DOUBLE) AS sample_weight FROM tr""")
def j04_weights_from_table(spark, sf):
    tr = _train(spark, sf)
    wfile = tr.select("front_id", (F.col("cnt_30") + 1).alias("sample_weight"))
    return wt.weights_from_table(tr.select("front_id"), wfile, "front_id")


@query("j05_mean_normalized", W("apps") + ", " + TR + """, x AS (SELECT front_id, GREATEST(POW(0.5, CAST(date_diff('day', decision_day,
  (SELECT MAX(decision_day) FROM tr)) AS DOUBLE) / 120.0), 0.25) AS w FROM tr)
SELECT front_id, ROUND(w / (SELECT AVG(w) FROM x), 6) AS sample_weight FROM x""")
def j05_mean_normalized(spark, sf):
    tr = _train(spark, sf)
    res = wt.sample_weights(tr, "decision_day", {"enabled": True, "strategy": "exponential_recency",
                                                 "half_life_days": 120, "min_weight": 0.25})
    return res.select("front_id", F.round("sample_weight", 6).alias("sample_weight"))


@query("j06_density_ratio_weights", W("scores") + """, r AS (SELECT front_id, GREATEST(0.01, LEAST(0.99, s1)) / (1 - GREATEST(0.01, LEAST(0.99, s1))) AS r FROM scores),
c AS (SELECT front_id, LEAST(r / (SELECT AVG(r) FROM r), 3.0) AS c FROM r)
SELECT front_id, ROUND(c / (SELECT AVG(c) FROM c), 6) AS sample_weight FROM c""")
def j06_density_ratio_weights(spark, sf):
    s = fx.scores(spark, sf)
    res = wt.density_ratio_weights(s, "s1", 0.01, 3.0)
    return res.select("front_id", F.round("sample_weight", 6).alias("sample_weight"))


@query("j07_class_balance", W("apps") + ", " + TR + """, c AS (SELECT CAST(SUM(target_value) AS DOUBLE) AS p, CAST(SUM(1 - target_value) AS DOUBLE) AS n FROM tr)
SELECT front_id, ROUND(CASE WHEN target_value = 1 THEN n / p ELSE 1.0 END, 9) AS w_balanced,
  ROUND(CASE WHEN target_value = 1 THEN SQRT(n / p) ELSE 1.0 END, 9) AS w_sqrt FROM tr, c""")
def j07_class_balance(spark, sf):
    tr = _train(spark, sf)
    return tr.select("front_id", F.round(wt.class_balance(tr, "target_value", "balanced"), 9).alias("w_balanced"),
                     F.round(wt.class_balance(tr, "target_value", "sqrt"), 9).alias("w_sqrt"))


@query("j08_pseudo_row_weight", W("scores") + """SELECT front_id, CAST(s1 > 0.5 AS INTEGER) AS pseudo_target, CAST(0.3 AS DOUBLE) AS sample_weight
FROM scores WHERE s1 > 0.85 OR s1 < 0.1""")
def j08_pseudo_row_weight(spark, sf):
    from ..operators.schema import confident_rows
    s = confident_rows(fx.scores(spark, sf), "s1", 0.85, 0.1)
    return s.select("front_id", "pseudo_target", wt.constant_weight(0.3).alias("sample_weight"))
