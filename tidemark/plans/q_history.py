"""Checks for the history roll-up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import history as hs
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.bucketed import attach_parts, write_bucketed
from ..sources.tables import read_table
from .catalog import query

W = fx.with_views


def _events(spark, sf):
    return read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value"])


def _matched(spark, sf):
    return hs.matched_history(_events(spark, sf), fx.apps(spark, sf), "user_id", "cust_id")


def _roll(spark, sf):
    m = _matched(spark, sf)
    return hs.rollup(m, "user_id", ["value"], flag=(F.col("event_type") == "error"))


HIST_SQL = """m AS (SELECT * FROM events WHERE user_id IN (SELECT cust_id FROM apps)),
r AS (SELECT user_id, COUNT(*) AS scoring_rn_count, AVG(value) AS scoring_value_mean, MAX(value) AS scoring_value_max,
  MIN(value) AS scoring_value_min, AVG(CAST(event_type = 'error' AS DOUBLE)) AS scoring_any_overdue_row_mean,
  MAX(CAST(event_type = 'error' AS INTEGER)) AS scoring_any_overdue_row_max FROM m GROUP BY user_id)"""


@query("a03_history_semi_join_scan", W("apps") + """SELECT event_id, user_id FROM events WHERE user_id IN (SELECT cust_id FROM apps)""")
def a03_history_semi_join_scan(spark, sf):
    return _matched(spark, sf).select("event_id", "user_id")


@query("e18_e19_history_rollup", W("apps") + ", " + HIST_SQL + """ SELECT user_id, scoring_rn_count, ROUND(scoring_value_mean, 9) AS scoring_value_mean,
  scoring_value_max, scoring_value_min, ROUND(scoring_any_overdue_row_mean, 9) AS scoring_any_overdue_row_mean, scoring_any_overdue_row_max FROM r""")
def e18_e19_history_rollup(spark, sf):
    r = _roll(spark, sf)
    for c in ("scoring_value_mean", "scoring_any_overdue_row_mean"):
        r = r.withColumn(c, F.round(c, 9))
    return r


@query("e18_e19_loan_history", W("apps") + """, m AS (SELECT user_id, event_id % 50 AS rn, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 3 AS DOUBLE) END AS pre_loans5,
  CAST(event_id % 7 - 6 AS DOUBLE) AS pre_loans30 FROM events WHERE user_id IN (SELECT cust_id FROM apps))
SELECT user_id, COUNT(*) AS scoring_rn_count, MAX(rn) AS scoring_rn_max, ROUND(AVG(pre_loans5), 9) AS scoring_pre_loans5_mean, MAX(pre_loans5) AS scoring_pre_loans5_max,
  MIN(pre_loans5) AS scoring_pre_loans5_min, ROUND(AVG(CASE WHEN pre_loans5 > 0 OR pre_loans30 > 0 THEN 1e0 ELSE 0e0 END), 9) AS scoring_any_overdue_row_mean,
  CAST(MAX(CASE WHEN pre_loans5 > 0 OR pre_loans30 > 0 THEN 1 ELSE 0 END) AS INTEGER) AS scoring_any_overdue_row_max FROM m GROUP BY user_id""")
def e18_e19_loan_history(spark, sf):
    """The overdue flag over loan columns, missing values among them, and the largest row number."""
    eid = F.col("event_id")
    m = _matched(spark, sf).select("user_id", (eid % 50).alias("rn"), F.when(eid % 4 != 0, (eid % 3).cast("double")).alias("pre_loans5"),
                                   (eid % 7 - 6).cast("double").alias("pre_loans30"))
    r = hs.rollup(m, "user_id", ["pre_loans5"], flag=hs.any_positive(["pre_loans5", "pre_loans30"]), row_number="rn")
    for c in ("scoring_pre_loans5_mean", "scoring_any_overdue_row_mean"):
        r = r.withColumn(c, F.round(c, 9))
    return r


@query("f04_history_left_join", W("apps") + ", " + HIST_SQL + """ SELECT front_id, CAST(scoring_rn_count AS DOUBLE) AS scoring_rn_count,
  ROUND(scoring_value_mean, 9) AS scoring_value_mean, scoring_value_max, scoring_value_min,
  ROUND(scoring_any_overdue_row_mean, 9) AS scoring_any_overdue_row_mean, CAST(scoring_any_overdue_row_max AS DOUBLE) AS scoring_any_overdue_row_max,
  CAST(r.user_id IS NOT NULL AS INTEGER) AS has_history FROM apps LEFT JOIN r ON apps.cust_id = r.user_id""")
def f04_history_left_join(spark, sf):
    j = hs.attach(fx.apps(spark, sf), _roll(spark, sf), "cust_id", "user_id")
    return j.select("front_id", "scoring_rn_count", F.round("scoring_value_mean", 9).alias("scoring_value_mean"),
                    "scoring_value_max", "scoring_value_min",
                    F.round("scoring_any_overdue_row_mean", 9).alias("scoring_any_overdue_row_mean"),
                    "scoring_any_overdue_row_max", "has_history")


BUCKETED_SQL = W("apps") + ", " + HIST_SQL + """ SELECT front_id, CAST(scoring_rn_count AS DOUBLE) AS scoring_rn_count,
  ROUND(scoring_value_mean, 9) AS scoring_value_mean, scoring_value_max, scoring_value_min, CAST(r.user_id IS NOT NULL AS INTEGER) AS has_history
  FROM apps LEFT JOIN r ON apps.cust_id = r.user_id"""


@query("a03_e18_f04_bucketed_history", BUCKETED_SQL)
def a03_e18_f04_bucketed_history(spark, sf):
    """History stored once in buckets of its key; semi-join, roll-up and left join read it in place."""
    events = _events(spark, sf).drop("event_type")
    place = scratch_path(spark, f"history-{uuid.uuid4().hex[:12]}")
    stored = write_bucketed(events, "user_id", place, int(spark.conf.get("spark.sql.shuffle.partitions")))
    apps = fx.apps(spark, sf)
    rolls = stored.matched(apps, "cust_id").rollups(lambda part: hs.rollup(part, "user_id", ["value"]))
    j = attach_parts(apps, rolls, "cust_id", "user_id")
    return j.select("front_id", "scoring_rn_count", F.round("scoring_value_mean", 9).alias("scoring_value_mean"),
                    "scoring_value_max", "scoring_value_min", "has_history")


@query("e20_history_coverage", W("apps") + ", " + HIST_SQL + """, j AS (SELECT apps.*, CAST(r.user_id IS NOT NULL AS INTEGER) AS has_history FROM apps LEFT JOIN r ON apps.cust_id = r.user_id)
SELECT is_test, COUNT(*) AS rows, COUNT(*) FILTER (WHERE has_history = 1) AS covered_rows,
  COUNT(*) FILTER (WHERE has_history = 1) / COUNT(*) AS covered_share,
  ROUND(AVG(CASE WHEN has_history = 1 THEN target_value END), 9) AS pos_rate_covered,
  ROUND(AVG(CASE WHEN has_history = 0 THEN target_value END), 9) AS pos_rate_not_covered,
  (SELECT COUNT(*) FROM m) AS matched_history_rows, (SELECT COUNT(DISTINCT user_id) FROM m) AS matched_ids FROM j GROUP BY is_test""")
def e20_history_coverage(spark, sf):
    j = hs.attach(fx.apps(spark, sf), _roll(spark, sf), "cust_id", "user_id")
    c = hs.coverage(j, "is_test", "target_value", _matched(spark, sf), "user_id")
    for k in ("pos_rate_covered", "pos_rate_not_covered"):
        c = c.withColumn(k, F.round(k, 9))
    return c
