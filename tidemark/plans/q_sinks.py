"""Checks for sources, sinks, run registry, config pipeline and contracts
(A01, A02, A04-A11, B02, B04, B14, M01, M05, M06, M09)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contract as ct
from ..operators import schema as sch
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks as sk
from ..sources.tables import read_csv_table, read_table, table_path
from . import config as cf
from .catalog import query

W = fx.with_views

APPS_SCHEMA = T.StructType([
    T.StructField("front_id", T.LongType()), T.StructField("decision_day", T.DateType()),
    T.StructField("cust_id", T.LongType()), T.StructField("loan_amount_last", T.DoubleType()),
    T.StructField("balance_amt", T.DoubleType()), T.StructField("db_group_last", T.StringType()),
    T.StructField("fl_adminarea", T.StringType()), T.StructField("cnt_30", T.DoubleType()),
    T.StructField("cnt_90", T.DoubleType()), T.StructField("target_value", T.IntegerType()),
    T.StructField("is_test", T.IntegerType()),
])


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("a01_csv_scan_declared_schema", W("apps") + "SELECT * FROM apps")
def a01_csv_scan_declared_schema(spark, sf):
    # Columns written in another order than the schema's: found by header name.
    path = _scratch(spark, "apps_csv")
    a = fx.apps(spark, sf)
    a.select(*reversed(a.columns)).write.mode("overwrite").option("header", True).csv(path)
    return read_csv_table(spark, path, APPS_SCHEMA)


@query("a02_projected_scan", "SELECT o_orderkey FROM orders")
def a02_projected_scan(spark, sf):
    return read_table(spark, sf, "orders", ["o_orderkey"])


def _write_runs(spark, sf, path):
    s = fx.scores(spark, sf)
    for run, col in (("m1_20240101T000000Z_seed42", "s1"), ("m1_20240301T000000Z_seed42", "s1"),
                     ("m2_20240201T000000Z_seed7", "s2")):
        sk.append_predictions(s, path, run, "oof", "fold", "front_id", "target_value", col)


@query("a04_a08_prediction_set_scan", W("scores") + """SELECT CAST(fold AS VARCHAR) AS grp, front_id AS row_index, target_value,
  s1 AS champion, s2 AS candidate FROM scores""")
def a04_a08_prediction_set_scan(spark, sf):
    path = _scratch(spark, "predictions")
    _write_runs(spark, sf, path)
    latest = sk.latest_runs(sk.run_registry(spark, path)).collect()
    by_prefix = {r["prefix"]: r["run_id"] for r in latest}
    return sk.load_runs(spark, path, {by_prefix["m1"]: "champion", by_prefix["m2"]: "candidate"}, "oof")


@query("a05_latest_run_lookup", """SELECT * FROM (VALUES ('m1', 'm1_20240301T000000Z_seed42', '20240301T000000Z'),
  ('m2', 'm2_20240201T000000Z_seed7', '20240201T000000Z')) t(prefix, run_id, stamp)""")
def a05_latest_run_lookup(spark, sf):
    path = _scratch(spark, "predictions")
    _write_runs(spark, sf, path)
    return sk.latest_runs(sk.run_registry(spark, path))


@query("a05_committed_runs", W("scores") + """SELECT p.prefix, p.run_id, COUNT(*) AS n_rows, CAST(SUM(s.target_value) AS BIGINT) AS n_pos FROM scores s
CROSS JOIN (VALUES ('m1', 'm1_20240101T000000Z_seed42', 1), ('m2', 'm2_20240201T000000Z_seed7', 2)) p(prefix, run_id, fold) WHERE s.fold <= p.fold GROUP BY p.prefix, p.run_id""")
def a05_committed_runs(spark, sf):
    """Rows of the newest committed run per prefix.  The later run of m1 and a
    repeat of m2's die between two artifacts: neither is seen."""
    root = _scratch(spark, "committed")
    s = fx.scores(spark, sf)
    broken = s.withColumn("s1", F.raise_error(F.lit("lost")).cast("double"))
    for run, fold, fails in (("m1_20240101T000000Z_seed42", 1, False), ("m1_20240301T000000Z_seed42", 3, True),
                             ("m2_20240201T000000Z_seed7", 2, False), ("m2_20240201T000000Z_seed7", 3, True)):
        tables = {"predictions": s.filter(F.col("fold") <= fold), "metrics": broken if fails else s.groupBy("fold").count()}
        try:
            sk.write_committed_run(root, run, tables)
        except Exception as error:
            if not fails or "lost" not in str(error):
                raise
    newest = sk.latest_runs(sk.run_ids(sk.committed_runs(spark, root))).drop("stamp")
    rows = sk.read_committed(spark, root, "predictions").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target_value").cast("long").alias("n_pos"))
    return newest.join(rows, "run_id").select("prefix", "run_id", "n_rows", "n_pos")


@query("a08_run_artifacts", W("apps", "scores") + """, r(run_id) AS (VALUES ('s1_20240101T000000Z_seed42'), ('s2_20240101T000000Z_seed42')),
c(artifact, n_rows) AS (SELECT 'valid_predictions', COUNT(*) FROM scores UNION ALL SELECT 'test_predictions', COUNT(*) FROM apps WHERE is_test = 1
  UNION ALL SELECT 'fold_metrics', COUNT(DISTINCT fold) + 1 FROM scores UNION ALL SELECT 'feature_manifest', 19 UNION ALL SELECT 'config', 1)
SELECT run_id, artifact, CAST(n_rows AS BIGINT) AS n_rows FROM r CROSS JOIN c""")
def a08_run_artifacts(spark, sf):
    from ..operators.metrics import fold_auc
    s = fx.scores(spark, sf)
    root = _scratch(spark, "runs")
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1").drop("target_value")
    _x, _tx, _names, manifest = cf.build_features(tr, te, CFG, APPS_SPECS)
    out = None
    for run, col in (("s1_20240101T000000Z_seed42", "s1"), ("s2_20240101T000000Z_seed42", "s2")):
        preds = s.select(F.col("front_id").alias("row_index"), "fold", "target_value", F.col(col).alias("prediction"))
        tests = te.select("front_id", ((F.col("front_id") % 1000).cast("double") / 1000.0).alias("prediction"))
        paths = sk.write_run_artifacts(root, run, {
            "valid_predictions": preds, "test_predictions": tests, "fold_metrics": fold_auc(preds, "target_value", "prediction", "fold"),
            "feature_manifest": sk.feature_manifest(spark, manifest)}, config=CFG)
    for name, path in paths.items():
        t = spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("artifact", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@query("a06_fixed_decimal_csv_sink", W("scores") + "SELECT front_id, printf('%.10f', s1) AS s1 FROM scores")
def a06_fixed_decimal_csv_sink(spark, sf):
    path = _scratch(spark, "submission_csv")
    s = fx.scores(spark, sf).select("front_id", "s1")
    sk.write_csv_fixed(s, path, ["s1"], order_by="front_id")
    schema = T.StructType([T.StructField("front_id", T.LongType()), T.StructField("s1", T.StringType())])
    return read_csv_table(spark, path, schema)


@query("a07_parquet_sink_history", W("apps") + "SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (SELECT cust_id FROM apps)")
def a07_parquet_sink_history(spark, sf):
    from ..operators.history import matched_history
    path = _scratch(spark, "history_rows")
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value"])
    sk.write_parquet(matched_history(ev, fx.apps(spark, sf), "user_id", "cust_id"), path)
    return spark.read.parquet(path)


@query("a09_json_summary", W("scores") + """SELECT '{"fold":' || fold || ',"n_rows":' || COUNT(*) || ',"n_pos":' || SUM(target_value) || '}' AS summary FROM scores GROUP BY fold""")
def a09_json_summary(spark, sf):
    # NaN and infinite values become missing, and missing fields are left out.
    from ..operators.metrics import auc_table
    a = auc_table(fx.scores(spark, sf), "target_value", "s2", ["fold"]).select("fold", "n_rows", "n_pos")
    return sk.json_summary(a.withColumn("ratio", F.when(F.col("fold") == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))))


@query("a10_m09_fingerprints", W("apps") + """SELECT t.name, t.matches, (SELECT COUNT(*) FROM apps) AS apps_rows, TRUE AS same_table, FALSE AS same_after_change
FROM (VALUES ('customer', TRUE), ('nation', FALSE), ('orders', TRUE)) t(name, matches)""")
def a10_m09_fingerprints(spark, sf):
    # Files copied to the shared folder, their card stored, then one file replaced.
    place = _scratch(spark, "fingerprints")
    names = ("orders", "customer", "nation")
    for n in names:
        read_table(spark, sf, n).coalesce(1).write.parquet(f"{place}/{n}")
    sk.file_fingerprints(spark, [f"{place}/{n}" for n in names], place).write.parquet(f"{place}-card")
    read_table(spark, sf, "nation").filter("n_nationkey > 0").coalesce(1).write.mode("overwrite").parquet(f"{place}/nation")
    chk = sk.check_fingerprint(sk.file_fingerprints(spark, [f"{place}/{n}" for n in names], place), spark.read.parquet(f"{place}-card"))
    a = fx.apps(spark, sf)
    tab, again = sk.table_fingerprint(a), sk.table_fingerprint(a.repartition(5))
    changed = sk.table_fingerprint(a.withColumn("cnt_30", F.when(F.col("front_id") == a.select(F.min("front_id")).scalar(), -1.0).otherwise(F.col("cnt_30"))))
    same = lambda x: (tab.select("xor_hash").scalar() == x.select("xor_hash").scalar()) & (tab.select("sum_hash").scalar() == x.select("sum_hash").scalar())
    return chk.select("name", "matches", tab.select("n_rows").scalar().alias("apps_rows"), same(again).alias("same_table"), same(changed).alias("same_after_change"))


@query("a10_chunk_digests", """SELECT t.name, TRUE AS same_length, TRUE AS one_root, t.n_changed FROM (VALUES ('customer', 0), ('orders', 0), ('nation', 1)) t(name, n_changed)""")
def a10_chunk_digests(spark, sf):
    """Digest trees of the table files from chunks of 64 KiB, before and after
    a copy of one is cut: lengths, one root a file, and tables with a change."""
    place = _scratch(spark, "chunks")
    names = ["orders", "customer", "nation"]
    for n in names:
        read_table(spark, sf, n).coalesce(1).write.parquet(f"{place}/{n}")
    paths = [f"{place}/{n}" for n in names]
    name = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name")
    # Files are replaced under a new name, so chunks are compared by folder.
    read = lambda: sk.chunk_digests(spark, paths, 1 << 16).withColumn("path", name)
    read().write.parquet(f"{place}-card")
    read_table(spark, sf, "nation").filter("n_nationkey > 0").coalesce(1).write.mode("overwrite").parquet(f"{place}/nation")
    read().write.parquet(f"{place}-now")
    card, now = (spark.read.parquet(f"{place}-{n}") for n in ("card", "now"))
    changed = sk.changed_chunks(now, card).select(F.col("path").alias("name")).distinct().withColumn("n_changed", F.lit(1))
    whole = sk.file_fingerprints(spark, paths).select(name, F.col("length").alias("bytes"))
    trees = sk.tree_digests(now, 16).groupBy(F.col("path").alias("name")).agg(F.sum("length").alias("length"), (F.count(F.lit(1)) == 1).alias("one_root"))
    return trees.join(whole, "name").join(changed, "name", "left").select(
        "name", (F.col("length") == F.col("bytes")).alias("same_length"), "one_root", F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


APPS_SPECS = [("cnt_30_to_90", "cnt_30", "cnt_90", "ratio"), ("balance_to_loan_amount", "balance_amt", "loan_amount_last", "ratio")]
CFG = {"id_col": "front_id", "day_col": "decision_day", "target": "target_value", "categorical": ["db_group_last", "fl_adminarea"],
       "time_features": {"include_day_num": True, "include_week": True},
       "feature_engineering": {"enabled": True, "add_pairwise_features": True, "add_missing_flags": True},
       "excluded_features": ["cust_id", "is_test"]}


@query("a11_b01_config_feature_table", W("apps") + """, tr AS (SELECT * FROM apps WHERE is_test = 0)
SELECT front_id, target_value, loan_amount_last, balance_amt, db_group_last, fl_adminarea, cnt_30, cnt_90,
  CAST(date_diff('day', (SELECT MIN(decision_day) FROM tr), decision_day) AS INTEGER) AS day_num, CAST(weekofyear(decision_day) AS INTEGER) AS week,
  CASE WHEN ABS(cnt_90) > 1e-9 THEN cnt_30 / cnt_90 END AS cnt_30_to_90,
  CASE WHEN ABS(loan_amount_last) > 1e-9 THEN balance_amt / loan_amount_last END AS balance_to_loan_amount,
  CAST(balance_amt IS NULL AS INTEGER) AS balance_amt_is_missing, CAST(cnt_90 IS NULL AS INTEGER) AS cnt_90_is_missing,
  CAST(CASE WHEN ABS(cnt_90) > 1e-9 THEN cnt_30 / cnt_90 END IS NULL AS INTEGER) AS cnt_30_to_90_is_missing,
  CAST(CASE WHEN ABS(loan_amount_last) > 1e-9 THEN balance_amt / loan_amount_last END IS NULL AS INTEGER) AS balance_to_loan_amount_is_missing
FROM tr""")
def a11_b01_config_feature_table(spark, sf):
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1").drop("target_value")
    cfg = cf.derive(CFG, {"time_features": {"include_week": True}})
    tr_x, _te_x, _names, _manifest = cf.build_features(tr, te, cfg, APPS_SPECS)
    return tr_x


# The manifest that CFG gives on the apps view: fixed values.
MANIFEST_SQL = ", ".join(f"('{c}', '{r}', {u}, '{t}', '{w}')" for c, r, u, t, w in [
    ("front_id", "id", False, "", "excluded"), ("decision_day", "date", False, "", "excluded"), ("cust_id", "numeric", False, "", "excluded"),
    ("loan_amount_last", "numeric", True, "loan_amount_last", ""), ("balance_amt", "numeric", True, "balance_amt", ""),
    ("db_group_last", "categorical", True, "db_group_last", ""), ("fl_adminarea", "categorical", True, "fl_adminarea", ""),
    ("cnt_30", "numeric", True, "cnt_30", ""), ("cnt_90", "numeric", True, "cnt_90", ""),
    ("target_value", "target", False, "", "excluded"), ("is_test", "numeric", False, "", "excluded"),
    *[(c, "derived", True, c, "label-free derived feature") for c in (
        "day_num", "week", "cnt_30_to_90", "balance_to_loan_amount", "balance_amt_is_missing", "cnt_90_is_missing",
        "cnt_30_to_90_is_missing", "balance_to_loan_amount_is_missing")]])


OFFER_CFG = {
    "id_col": "row_id", "day_col": "decision_day", "target": "target_value", "categorical": ["l_linestatus", "l_returnflag"],
    "time_features": {"include_day_num": True, "include_month": True, "include_dayofweek": True, "include_week": True},
    "feature_engineering": {"enabled": True, "add_rate_limit_features": True, "add_context_offer_features": True,
                            "add_same_day_context_offer_features": True, "add_missing_flags": True, "context_columns": ["l_orderkey"]},
    "sample_weight": {"enabled": True, "strategy": "exponential_recency", "half_life_days": 240, "min_weight": 0.25},
    "cutoffs": ["1995-01-01", "1996-01-01", "1997-01-01"], "excluded_features": ["l_returnflag"],
}
OFFER_TEST = "1998-01-01"


def _offer_sides(spark, sf):
    """Offers with a unique row id, split at ``OFFER_TEST``."""
    rid = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "overdraft_limit_max")])
    o = fx.offers(spark, sf).withColumn("row_id", rid).drop("l_linenumber", "l_partkey")
    late = F.col("decision_day") >= F.lit(OFFER_TEST).cast("date")
    return o.filter(~late), o.filter(late).drop("target_value")


def _group_sql(tag: str, keys: str, flags: bool) -> str:
    out = [f"CAST(COUNT(*) OVER (PARTITION BY {keys}) AS INTEGER) AS {tag}_offer_count"]
    for c in fx.OFFER_COLS:
        p = f"PARTITION BY {keys}"
        out += [f"ROUND(MAX({c}) OVER ({p}) - MIN({c}) OVER ({p}), 6) + 0e0 AS {c}_{tag}_spread", f"ROUND({c} - MIN({c}) OVER ({p}), 6) + 0e0 AS {c}_minus_{tag}_min",
                f"ROUND({c} - AVG({c}) OVER ({p}), 6) + 0e0 AS {c}_minus_{tag}_mean",
                f"CASE WHEN {c} IS NOT NULL THEN ROUND((RANK() OVER ({p} ORDER BY {c} NULLS LAST) + (COUNT(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0) / COUNT({c}) OVER ({p}), 9) END AS {c}_rank_pct_in_{tag}"]
        if flags:
            out += [f"COALESCE(CAST({c} = MIN({c}) OVER ({p}) AS INTEGER), 0) AS {c}_is_{tag}_min", f"COALESCE(CAST({c} = MAX({c}) OVER ({p}) AS INTEGER), 0) AS {c}_is_{tag}_max"]
    return ", ".join(out)


OFFERS_ID_SQL = W("offers") + f""", o AS (SELECT *, concat_ws(':', l_orderkey, l_linenumber, l_partkey, overdraft_limit_max) AS row_id FROM offers),
tr AS (SELECT * FROM o WHERE decision_day < DATE '{OFFER_TEST}')"""


@query("a11_offers_feature_table", OFFERS_ID_SQL + f"""
SELECT l_orderkey, target_value, decision_day, l_linestatus, offered_rate, overdraft_limit_min, overdraft_limit_max,
  CAST(date_diff('day', (SELECT MIN(decision_day) FROM tr), decision_day) AS INTEGER) AS day_num, strftime(decision_day, '%Y-%m') AS month,
  CAST(isodow(decision_day) - 1 AS INTEGER) AS dayofweek, CAST(weekofyear(decision_day) AS INTEGER) AS week,
  ROUND(overdraft_limit_max - overdraft_limit_min, 6) AS overdraft_limit_spread, ROUND((overdraft_limit_min + overdraft_limit_max) / 2.0, 6) AS overdraft_limit_mid,
  {_group_sql("context", "l_orderkey", False)}, {_group_sql("same_day_context", "l_orderkey, decision_day", True)},
  CAST(offered_rate IS NULL AS INTEGER) AS offered_rate_is_missing FROM tr""")
def a11_offers_feature_table(spark, sf):
    """Every feature switch on the offers, compared without the columns' text ids."""
    tr, te = _offer_sides(spark, sf)
    x, _te, names, _ = cf.build_features(tr, te, OFFER_CFG)
    assert "decision_day" not in names and "l_returnflag" not in names
    doubles = {c for c, t in x.dtypes if t == "double"} - set(fx.OFFER_COLS)
    flags = {c for c in x.columns if c.endswith("_is_missing")} - {"offered_rate_is_missing"}
    joined = x.join(tr.select("row_id", "decision_day"), "row_id").drop("row_id", *flags)
    return joined.select(*[(F.round(c, 9 if "rank_pct" in c else 6) + 0.0).alias(c) if c in doubles else F.col(c) for c in joined.columns])


@query("a11_weights_per_fold", OFFERS_ID_SQL + """, x AS (SELECT decision_day, GREATEST(POW(0.5, CAST(date_diff('day', decision_day,
  (SELECT MAX(decision_day) FROM tr)) AS DOUBLE) / 240.0), 0.25) AS w FROM tr),
n AS (SELECT decision_day, w / (SELECT AVG(w) FROM x) AS w FROM x),
c(fold, cutoff, valid_end) AS (VALUES (1, DATE '1995-01-01', DATE '1996-01-01'), (2, DATE '1996-01-01', DATE '1997-01-01'),
  (3, DATE '1997-01-01', (SELECT MAX(decision_day) + 1 FROM tr)))
SELECT fold, COUNT(*) AS n_rows, ROUND(SUM(w), 3) AS w_sum, ROUND(MIN(w), 6) AS w_min, ROUND(MAX(w), 6) AS w_max
FROM n JOIN c ON decision_day < cutoff WHERE EXISTS (SELECT 1 FROM n v WHERE v.decision_day >= c.cutoff AND v.decision_day < c.valid_end) GROUP BY fold""")
def a11_weights_per_fold(spark, sf):
    tr, _ = _offer_sides(spark, sf)
    w = cf.weights_per_fold(tr, OFFER_CFG)
    return w.select("fold", "n_rows", F.round("w_sum", 3).alias("w_sum"), F.round("w_min", 6).alias("w_min"), F.round("w_max", 6).alias("w_max"))


@query("a11_run_invariants", W("apps") + """, v AS (SELECT target_value, CASE WHEN decision_day < DATE '1999-07-01' THEN '1' WHEN decision_day < DATE '2000-01-01' THEN '2' ELSE '3' END AS fold
  FROM apps WHERE is_test = 0 AND decision_day >= DATE '1999-01-01')
SELECT 'valid' AS part, fold, COUNT(*) AS n_rows, CAST(SUM(target_value) AS BIGINT) AS n_pos, TRUE AS once, TRUE AS in_unit FROM v GROUP BY fold
UNION ALL SELECT 'test', NULL, COUNT(*), NULL, TRUE, TRUE FROM apps WHERE is_test = 1""")
def a11_run_invariants(spark, sf):
    """The whole configured run: each validation row scored once in its fold, each test row once, scores in [0, 1]."""
    a = fx.apps(spark, sf)
    cfg = cf.derive(CFG, {"cutoffs": list(fx.FOLD_CUTOFFS), "model": {"model_type": "gbt", "iterations": 4, "depth": 3, "class_weight": "sqrt"},
                          "sample_weight": {"enabled": True, "strategy": "linear_recency"}})
    run = cf.run_config(a.filter("is_test = 0"), a.filter("is_test = 1").drop("target_value"), cfg, APPS_SPECS)
    p = F.col("prediction")
    facts = [F.count(F.lit(1)).alias("n_rows"), F.sum("target_value").cast("long").alias("n_pos"),
             (F.countDistinct("front_id") == F.count(F.lit(1))).alias("once"), (F.count_if((p >= 0) & (p <= 1)) == F.count(F.lit(1))).alias("in_unit")]
    valid = run["valid_predictions"].groupBy("fold").agg(*facts).select(F.lit("valid").alias("part"), "fold", "n_rows", "n_pos", "once", "in_unit")
    test = run["test_predictions"].withColumn("target_value", F.lit(None).cast("int")).agg(*facts)
    return valid.unionByName(test.select(F.lit("test").alias("part"), F.lit(None).cast("string").alias("fold"), "n_rows", "n_pos", "once", "in_unit"))


@query("b02_b04_b14_schema_checks", f"""SELECT t.*, TRUE AS aligned, 'no_such_column' AS skipped_requested, 'loan_amount_last,cnt_90' AS kept_requested
FROM (VALUES {MANIFEST_SQL}) t(source_column, role, used, transformed_to, reason)""")
def b02_b04_b14_schema_checks(spark, sf):
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1").drop("target_value")
    kept, skipped = sch.resolve_columns(tr.columns, ["loan_amount_last", "cnt_90", "no_such_column"])
    _tr_x, _te_x, _names, manifest = cf.build_features(tr, te, CFG, APPS_SPECS)
    aligned = True
    try:
        sch.check_aligned(tr.drop("target_value"), te)
    except ValueError:
        aligned = False
    return sk.feature_manifest(spark, manifest).withColumn("aligned", F.lit(aligned)).withColumn(
        "skipped_requested", F.lit(",".join(skipped))).withColumn("kept_requested", F.lit(",".join(kept)))


@query("m01_submission_contract", W("apps") + """, te AS (SELECT front_id FROM apps WHERE is_test = 1)
SELECT * FROM (VALUES ('columns', TRUE, 'front_id,target_value')) t(check_name, passed, detail)
UNION ALL SELECT 'row_count', COUNT(*) = (SELECT COUNT(*) FROM te), CAST(COUNT(*) AS VARCHAR) FROM te
UNION ALL SELECT 'unique_ids', COUNT(DISTINCT front_id) = COUNT(*), CAST(COUNT(DISTINCT front_id) AS VARCHAR) FROM te
UNION ALL SELECT 'id_order', TRUE, CAST(COUNT(*) AS VARCHAR) FROM te
UNION ALL SELECT 'finite', TRUE, '0' UNION ALL SELECT 'range_0_1', TRUE, '0'""")
def m01_submission_contract(spark, sf):
    from ..operators.blend import rank_blend
    te = fx.test_apps(spark, sf)
    fid = F.col("front_id")
    te = te.select("front_id", ((fid * 7919 % 1000).cast("double") / 1150.0).alias("s1"),
                   ((fid * 104729 % 97).cast("double") / 109.0).alias("s2"))
    b = rank_blend(te, "s1", "s2", 0.7, "target_value")
    sub = ct.submission_table(te.select("front_id"), b.select("front_id", "target_value"), "front_id")
    return ct.submission_contract(sub, te.select("front_id"), "front_id")


@query("m05_label_free_features", "SELECT TRUE AS label_free")
def m05_label_free_features(spark, sf):
    a = fx.apps(spark, sf)
    tr, te = a.filter("is_test = 0"), a.filter("is_test = 1").drop("target_value")

    def build(df):
        x, _, _, _ = cf.build_features(df, te, CFG, APPS_SPECS)
        return x

    ok = ct.label_free(build, tr, "target_value", "front_id")
    return spark.range(1).select(F.lit(ok).alias("label_free"))


@query("m06_non_finite_scores", W("scores") + """SELECT COUNT(*) FILTER (WHERE s1 IS NULL OR isnan(s1) OR isinf(s1)) AS s1,
  COUNT(*) FILTER (WHERE s2 IS NULL OR isnan(s2) OR isinf(s2)) AS s2 FROM scores""")
def m06_non_finite_scores(spark, sf):
    return ct.non_finite_count(fx.scores(spark, sf), ["s1", "s2"])
