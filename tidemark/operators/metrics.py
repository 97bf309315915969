"""Exact ROC-AUC and score / weight summaries.

AUC is computed by rank sum with average ties, keyed by any grouping columns,
in one plan:

* ``groupBy(keys, score)`` with integer positive / negative counts - partial
  aggregation on the map side, so the shuffle carries distinct scores, not
  rows;
* negatives strictly below each score: inside a deterministic value bucket
  (:func:`ranks.with_buckets`) by a window, across the buckets of a key from
  their totals, so one group is never one task's;
* ``sum(pos * (2 * neg_below + neg)) / (2 * P * N)`` per key, summed up per
  bucket first.  The numerator
  is summed as ``decimal(38,0)`` so it cannot overflow at any scale; the only
  floating-point step is the final division, so results are bit-equal across
  engines.  A key with one class gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import BUCKET, with_buckets

DEC = "decimal(38,0)"


def auc_table(
    df: DataFrame,
    label: str,
    score: str,
    keys: Sequence[str] = (),
    weight: str | None = None,
    out: str = "roc_auc",
    count: str | None = None,
) -> DataFrame:
    """One row per ``keys`` group: ``roc_auc``, ``n_rows``, ``n_pos``, ``n_neg``.
    ``count`` names a column of row multiplicities (rows already grouped).

    Rows with a missing score or label are ignored.  With ``weight`` the
    counts become weight sums (test-weighted AUC, E37) and the arithmetic is
    double.
    """
    keys = list(keys)
    y = F.col(label)
    n = F.col(count).cast("long") if count else F.lit(1).cast("long")
    if weight is None:
        pos_v, neg_v = y.cast("long") * n, (1 - y).cast("long") * n
    else:
        w = F.col(weight).cast("double")
        pos_v, neg_v = y * w, (1 - y) * w
    base = df.filter(F.col(score).isNotNull() & y.isNotNull())
    dist = base.groupBy(*keys, score).agg(
        F.sum(pos_v).alias("__pos"), F.sum(neg_v).alias("__neg"), F.sum(n).alias("__rows")
    )
    exact = (lambda c: F.col(c).cast(DEC)) if weight is None else F.col
    # Inside a value bucket: negatives below by a window, then one row per
    # (group, bucket) without another exchange.
    in_bucket = Window.partitionBy(*keys, BUCKET).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    local = with_buckets(dist, score).withColumn("__below", F.coalesce(F.sum("__neg").over(in_bucket), F.lit(0)))
    parts = local.groupBy(*keys, BUCKET).agg(
        F.sum(exact("__pos") * (2 * exact("__below") + exact("__neg"))).alias("__num"),
        F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"), F.sum("__rows").alias("__rows"))
    # Across the buckets of a group (at most ``BUCKETS`` rows): every positive
    # also beats the negatives of all buckets below.
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__below", F.coalesce(F.sum("__neg").over(across), F.lit(0)))
    agg = parts.groupBy(*keys).agg(
        F.sum(F.col("__num") + 2 * exact("__pos") * exact("__below")).alias("__num"),
        F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"), F.sum("__rows").alias("n_rows"))
    return _finish(agg, keys, weight, out)


def _finish(agg: DataFrame, keys: list, weight: str | None, out: str) -> DataFrame:
    den = 2 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("__num").cast("double") / den)
    cols = [*keys, auc.alias(out), F.col("n_rows").cast("long").alias("n_rows")]
    if weight is None:
        cols += [F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg")]
    else:
        cols += [F.col("n_pos").alias("w_pos"), F.col("n_neg").alias("w_neg")]
    return agg.select(*cols)


def fold_auc(df: DataFrame, label: str, score: str, fold: str = "fold", pooled_name: str = "OOF_TIME_HOLDOUT") -> DataFrame:
    """AUC per fold plus the pooled out-of-fold AUC.

    The pooled value is its own pass over all rows - it is not the mean of
    fold AUCs.
    """
    per = auc_table(df, label, score, [fold]).select(F.col(fold).cast("string").alias(fold), "roc_auc", "n_rows", "n_pos")
    pooled = auc_table(df, label, score).select(F.lit(pooled_name).alias(fold), "roc_auc", "n_rows", "n_pos")
    return per.unionByName(pooled)


def holdout_battery(aucs: DataFrame, key: str = "holdout", metric: str = "roc_auc") -> DataFrame:
    """Append MEAN / STD (population) / MIN rows to a per-holdout table."""
    body = aucs.select(F.col(key).cast("string").alias(key), F.col(metric))
    summ = aucs.agg(
        F.avg(metric).alias("MEAN"), F.stddev_pop(metric).alias("STD"), F.min(metric).alias("MIN")
    )
    long = summ.unpivot([], ["MEAN", "STD", "MIN"], key, metric)
    return body.unionByName(long)


def late_part_auc(df: DataFrame, label: str, score: str, day: str, start: str) -> DataFrame:
    """AUC over rows on or after ``start`` (E39); null if one class."""
    return auc_table(df.filter(F.col(day) >= F.lit(start).cast("date")), label, score)


def score_profile(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Prediction profile (E30): rows, min, mean, max, distinct, NaN, inf."""
    x = F.col(col)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(x).alias("min"),
        F.avg(x).alias("mean"),
        F.max(x).alias("max"),
        F.countDistinct(x).alias("n_distinct"),
        F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(F.abs(x) == float("inf")).alias("n_inf"),
    )


def weight_profile(df: DataFrame, w: str) -> DataFrame:
    """Weight profile (E31): effective sample size and its share, min, max,
    p99 (exact, no value list in one buffer), rows below 0.01."""
    from .drift import exact_quantiles

    x = F.col(w)
    p99 = exact_quantiles(df, [], w, [0.99]).select(F.max("quantile")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.pow(F.sum(x), 2) / F.sum(x * x)).alias("ess"),
        (F.pow(F.sum(x), 2) / F.sum(x * x) / F.count(F.lit(1))).alias("ess_share"),
        F.min(x).alias("w_min"),
        F.max(x).alias("w_max"),
        F.count_if(x < 0.01).alias("n_below_001"),
    ).select("n_rows", "ess", "ess_share", "w_min", "w_max", p99.alias("w_p99"), "n_below_001")


def correlations(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), ra: str | None = None, rb: str | None = None) -> DataFrame:
    """Pearson correlation per group (E27); Spearman when average-rank columns
    ``ra``/``rb`` are supplied (ranks from :func:`ranks.average_rank_pct`)."""
    aggs = [F.corr(a, b).alias("pearson")]
    if ra and rb:
        aggs.append(F.corr(ra, rb).alias("spearman"))
    return df.groupBy(*keys).agg(*aggs)


def round6(c: Column | str) -> Column:
    """Six-decimal rounding used in cross-engine comparisons of float sums."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
