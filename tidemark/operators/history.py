"""External history roll-up and its join coverage.

The history table is scanned once with a left-semi join against the key set
of the applications (Catalyst prunes columns, AQE adds a runtime bloom filter
to the scan); the roll-up is one ``groupBy(id)`` with partial aggregation, so
an id holding a third of all history rows is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_history(history: DataFrame, apps: DataFrame, hist_key: str, app_key: str) -> DataFrame:
    """History rows whose key occurs among the applications."""
    ids = apps.select(F.col(app_key).alias(hist_key)).filter(F.col(hist_key).isNotNull()).distinct()
    return history.join(ids, hist_key, "left_semi")


def rollup(history: DataFrame, key: str, value_cols: Sequence[str], flag: Column | None = None,
           prefix: str = "scoring", row_number: str | None = None) -> DataFrame:
    """Per key the row count, mean / max / min of every value
    column (``<prefix>_<col>_<stat>``), with ``row_number`` its largest value,
    and, with ``flag``, the mean and max of the per-row flag."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_rn_count")]
    if row_number:
        aggs.append(F.max(row_number).alias(f"{prefix}_rn_max"))
    for c in value_cols:
        aggs += [F.avg(c).alias(f"{prefix}_{c}_mean"), F.max(c).alias(f"{prefix}_{c}_max"), F.min(c).alias(f"{prefix}_{c}_min")]
    if flag is not None:
        aggs += [F.avg(flag.cast("double")).alias(f"{prefix}_any_overdue_row_mean"),
                 F.max(flag.cast("int")).alias(f"{prefix}_any_overdue_row_max")]
    return history.groupBy(key).agg(*aggs)


def any_positive(cols: Sequence[str]) -> Column:
    """1 when any column is > 0 (missing counts as not positive)."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c) > 0, F.lit(False))
    return out.cast("int")


def attach(apps: DataFrame, roll: DataFrame, app_key: str, hist_key: str) -> DataFrame:
    """left join of the roll-up, values cast to double, plus has_history."""
    r = roll.withColumnRenamed(hist_key, "__hk")
    vals = [c for c in roll.columns if c != hist_key]
    j = apps.join(r, apps[app_key] == r["__hk"], "left")
    return j.select(*apps.columns, *[F.col(c).cast("double").alias(c) for c in vals],
                    F.col("__hk").isNotNull().cast("int").alias("has_history"))


def coverage(joined: DataFrame, side: str, target: str, history_rows: DataFrame, hist_key: str) -> DataFrame:
    """Per side covered rows and share, positive rate with and without
    history; plus matched history rows and ids."""
    h = F.col("has_history") == 1
    per = joined.groupBy(side).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(h).alias("covered_rows"),
        (F.count_if(h) / F.count(F.lit(1))).alias("covered_share"),
        F.avg(F.when(h, F.col(target))).alias("pos_rate_covered"),
        F.avg(F.when(~h, F.col(target))).alias("pos_rate_not_covered"))
    m = history_rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(hist_key).alias("d"))
    return per.select("*", m.select("n").scalar().alias("matched_history_rows"),
                      m.select("d").scalar().alias("matched_ids"))
