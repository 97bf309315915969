"""Checks for context features and context reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import splits
from ..operators.schema import split_feature_space
from ..sources import fixtures as fx
from .catalog import query

W = fx.with_views
OFFER = fx.OFFER_COLS
KEY = ["l_orderkey"]
SAME_DAY = ["l_linestatus", "l_returnflag", "decision_day"]


def _ctx_sql(part: str, tag: str, flags: bool) -> str:
    cols = [f"CAST(COUNT(*) OVER (PARTITION BY {part}) AS INTEGER) AS {tag}_offer_count"]
    for c in OFFER:
        w = f"(PARTITION BY {part})"
        cols += [
            f"MAX({c}) OVER {w} - MIN({c}) OVER {w} AS {c}_{tag}_spread",
            f"{c} - MIN({c}) OVER {w} AS {c}_minus_{tag}_min",
            f"ROUND({c} - AVG({c}) OVER {w}, 6) + 0e0 AS {c}_minus_{tag}_mean",
            f"CASE WHEN {c} IS NOT NULL THEN (RANK() OVER (PARTITION BY {part} ORDER BY {c} NULLS LAST)"
            f" + (COUNT({c}) OVER (PARTITION BY {part}, {c}) - 1) / 2) / COUNT({c}) OVER {w} END AS {c}_rank_pct_in_{tag}",
        ]
        if flags:
            cols += [
                f"COALESCE(CAST({c} = MIN({c}) OVER {w} AS INTEGER), 0) AS {c}_is_{tag}_min",
                f"COALESCE(CAST({c} = MAX({c}) OVER {w} AS INTEGER), 0) AS {c}_is_{tag}_max",
            ]
    return W("offers") + "SELECT l_orderkey, l_linenumber, l_partkey, " + ",\n  ".join(cols) + " FROM offers"


def _round_means(df, tag):
    for c in OFFER:
        n = f"{c}_minus_{tag}_mean"
        df = df.withColumn(n, F.round(n, 6))
    return df


def _ctx_query(spark, sf, keys, tag, flags, strategy):
    o = fx.offers(spark, sf)
    out = ctx.context_features(o, keys, OFFER, tag=tag, flags=flags, strategy=strategy)
    keep = ["l_orderkey", "l_linenumber", "l_partkey"] + [c for c in out.columns if c not in o.columns]
    return _round_means(out.select(*keep), tag)


@query("d01_d03_context_offer_features", _ctx_sql("l_orderkey", "context", False))
def d01_d03_context_offer_features(spark, sf):
    return _ctx_query(spark, sf, KEY, "context", False, "split")


@query("d01_d03_context_features_skew_safe", _ctx_sql("l_orderkey", "context", False))
def d01_d03_context_features_skew_safe(spark, sf):
    return _ctx_query(spark, sf, KEY, "context", False, "aggregate")


@query("d04_d05_same_day_context_features", _ctx_sql(", ".join(SAME_DAY), "same_day_context", True))
def d04_d05_same_day_context_features(spark, sf):
    return _ctx_query(spark, sf, SAME_DAY, "same_day_context", True, "split")


@query("d04_d05_same_day_skew_safe", _ctx_sql(", ".join(SAME_DAY), "same_day_context", True))
def d04_d05_same_day_skew_safe(spark, sf):
    return _ctx_query(spark, sf, SAME_DAY, "same_day_context", True, "aggregate")


@query("b10_feature_space_split", W("offers") + """SELECT l_orderkey, l_linenumber, l_partkey, offered_rate, overdraft_limit_min, overdraft_limit_max,
  CAST(COUNT(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS context_offer_count,
  MAX(offered_rate) OVER (PARTITION BY l_orderkey) - MIN(offered_rate) OVER (PARTITION BY l_orderkey) AS offered_rate_context_spread
FROM offers""")
def b10_feature_space_split(spark, sf):
    o = fx.offers(spark, sf)
    feats = ctx.context_features(o.select("l_orderkey", "l_linenumber", "l_partkey", "offered_rate", "overdraft_limit_min",
                                          "overdraft_limit_max"), KEY, ["offered_rate"], strategy="split")
    cols = ["offered_rate", "overdraft_limit_min", "overdraft_limit_max", "context_offer_count", "offered_rate_context_spread"]
    _absolute, relative = split_feature_space(cols, OFFER)
    return feats.select("l_orderkey", "l_linenumber", "l_partkey", *relative)


@query("e08_context_size_histogram", W("offers") + """, g AS (SELECT l_orderkey, COUNT(*) AS size, SUM(target_value) AS pos FROM offers GROUP BY l_orderkey)
SELECT size, COUNT(*) AS n_contexts, CAST(SUM(size) AS BIGINT) AS n_rows, CAST(SUM(pos) AS DOUBLE) / SUM(size) AS pos_rate FROM g GROUP BY size""")
def e08_context_size_histogram(spark, sf):
    return ctx.context_size_histogram(fx.offers(spark, sf), KEY, "target_value")


@query("e08_offer_prevalence", W("offers") + """, g AS (SELECT l_orderkey, COUNT(*) AS size, SUM(target_value) AS pos FROM offers GROUP BY l_orderkey)
SELECT size > 1 AS multi_offer, CAST(SUM(size) AS BIGINT) AS n_rows, CAST(SUM(pos) AS DOUBLE) / SUM(size) AS pos_rate FROM g GROUP BY 1""")
def e08_offer_prevalence(spark, sf):
    return ctx.offer_prevalence(fx.offers(spark, sf), KEY, "target_value")


@query("e10_train_test_context_overlap", W("offers") + """, tr AS (SELECT * FROM offers WHERE decision_day < DATE '1997-01-01'), te AS (SELECT * FROM offers WHERE decision_day >= DATE '1997-01-01')
SELECT (SELECT COUNT(*) FROM (SELECT l_partkey FROM tr INTERSECT SELECT l_partkey FROM te)) AS shared_contexts,
  (SELECT COUNT(*) FROM tr WHERE l_partkey IN (SELECT l_partkey FROM te)) AS train_rows_shared,
  (SELECT COUNT(*) FROM te WHERE l_partkey IN (SELECT l_partkey FROM tr)) AS test_rows_shared""")
def e10_train_test_context_overlap(spark, sf):
    o = fx.offers(spark, sf)
    late = F.col("decision_day") >= F.lit("1997-01-01").cast("date")
    return ctx.context_overlap(o.filter(~late), o.filter(late), ["l_partkey"])


@query("e10_context_report", W("offers") + """, g AS (SELECT l_orderkey, COUNT(*) AS size, COUNT(DISTINCT target_value) AS k,
  COUNT(DISTINCT offered_rate) AS d1, COUNT(DISTINCT overdraft_limit_min) AS d2, COUNT(DISTINCT overdraft_limit_max) AS d3
  FROM offers GROUP BY l_orderkey)
SELECT COUNT(*) AS n_contexts, COUNT(*) FILTER (WHERE size > 1) AS n_repeated,
  CAST(COALESCE(SUM(size) FILTER (WHERE size > 1), 0) AS BIGINT) AS rows_in_repeated, MAX(size) AS max_size,
  COUNT(*) FILTER (WHERE d1 > 1 OR d2 > 1 OR d3 > 1) AS n_varying_terms,
  COUNT(*) FILTER (WHERE size > 1 AND k > 1) AS n_conflicting,
  CAST(COALESCE(SUM(size) FILTER (WHERE size > 1 AND k > 1), 0) AS BIGINT) AS rows_in_conflicting FROM g""")
def e10_context_report(spark, sf):
    return ctx.context_report(fx.offers(spark, sf), KEY, OFFER, "target_value")


@query("e11_e12_repeated_contexts_by_month", W("offers") + """, g AS (SELECT strftime(decision_day, '%Y-%m') AS month, l_linestatus, l_returnflag, decision_day,
  COUNT(*) AS size, COUNT(DISTINCT target_value) AS k, SUM(target_value) AS pos FROM offers GROUP BY ALL)
SELECT month, COUNT(*) FILTER (WHERE size > 1) AS repeated_groups, CAST(COALESCE(SUM(size) FILTER (WHERE size > 1), 0) AS BIGINT) AS repeated_rows,
  MAX(size) AS max_size, COUNT(*) FILTER (WHERE size > 1 AND k > 1) AS conflict_groups,
  CAST(COALESCE(SUM(size) FILTER (WHERE size > 1 AND k > 1), 0) AS BIGINT) AS conflict_rows,
  CAST(COALESCE(SUM(pos) FILTER (WHERE size > 1 AND k > 1), 0) AS BIGINT) AS conflict_pos FROM g GROUP BY month""")
def e11_e12_repeated_contexts_by_month(spark, sf):
    return ctx.repeated_by_month(fx.offers(spark, sf), SAME_DAY, "decision_day", "target_value")


OFFER_FOLDS = ("1995-01-01", "1996-01-01", "1997-01-01")


@query("e13_fold_context_overlap", W("offers") + """, f AS (SELECT * FROM (VALUES (1, DATE '1995-01-01'), (2, DATE '1996-01-01'), (3, DATE '1997-01-01')) t(fold, cutoff)),
spec AS (SELECT fold, cutoff, COALESCE(LEAD(cutoff) OVER (ORDER BY fold), (SELECT MAX(decision_day) FROM offers) + 1) AS valid_end FROM f),
m AS (SELECT s.fold, CASE WHEN o.decision_day < s.cutoff THEN 'train' ELSE 'valid' END AS role, o.* FROM offers o JOIN spec s ON o.decision_day < s.valid_end),
sides AS (SELECT fold, COUNT(*) FILTER (WHERE role = 'train') AS train_rows, COUNT(*) FILTER (WHERE role = 'valid') AS valid_rows,
  MIN(decision_day) FILTER (WHERE role = 'train') AS train_start, MAX(decision_day) FILTER (WHERE role = 'train') AS train_end,
  MIN(decision_day) FILTER (WHERE role = 'valid') AS valid_start, MAX(decision_day) FILTER (WHERE role = 'valid') AS valid_end FROM m GROUP BY fold),
g AS (SELECT fold, l_linestatus, l_returnflag, COUNT(*) FILTER (WHERE role = 'train') AS t, COUNT(*) FILTER (WHERE role = 'valid') AS v FROM m GROUP BY ALL),
sh AS (SELECT fold, COUNT(*) AS shared_contexts, CAST(SUM(t) AS BIGINT) AS train_rows_shared, CAST(SUM(v) AS BIGINT) AS valid_rows_shared
  FROM g WHERE t > 0 AND v > 0 GROUP BY fold)
SELECT sides.*, COALESCE(shared_contexts, 0) AS shared_contexts, COALESCE(train_rows_shared, 0) AS train_rows_shared,
  COALESCE(valid_rows_shared, 0) AS valid_rows_shared FROM sides LEFT JOIN sh USING (fold)""")
def e13_fold_context_overlap(spark, sf):
    o = fx.offers(spark, sf)
    spec = splits.fold_spec(o, "decision_day", OFFER_FOLDS)
    m = splits.assign_folds(o, "decision_day", spec)
    return ctx.fold_context_overlap(m, ["l_linestatus", "l_returnflag"], "decision_day")
