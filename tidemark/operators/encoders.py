"""Supervised and frequency encoders fitted without leakage.

Statistics are grouped on the fit rows and attached to the rows to transform
with an equi-join (a missing category never matches, exactly like a map
lookup).  The statistics side has one row per category; AQE broadcasts it at
runtime when it is small, and a category holding a third of the rows only
costs a skewed join partition that AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPS_FOLDSAFE, finite, safe_divide
from ..session import cut_lineage
from .splits import hash_order, stratified_kfold


def segment_stats(fit: DataFrame, transform: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str],
                  min_count: int = 20, add_diff: bool = True, add_ratio: bool = True,
                  add_zscore: bool = True) -> DataFrame:
    """Per (category, numeric) fit mean, sample std and count (all
    missing when count < min_count), plus value - mean, value / mean and
    z-score on the transform rows.  Unseen or missing categories get missing."""
    out = transform
    for cat in cat_cols:
        aggs = []
        for num in num_cols:
            p = f"{cat}__{num}__seg_"
            cnt = F.count(num)
            ok = cnt >= min_count
            aggs += [F.when(ok, F.avg(num)).alias(p + "mean"), F.when(ok, F.stddev_samp(num)).alias(p + "std"),
                     F.when(ok, cnt).alias(p + "count")]
        stats = fit.filter(F.col(cat).isNotNull()).groupBy(cat).agg(*aggs).withColumnRenamed(cat, "__cat")
        out = out.join(stats, out[cat] == stats["__cat"], "left").drop("__cat")
        for num in num_cols:
            p = f"{cat}__{num}__"
            mean, std = F.col(p + "seg_mean"), F.col(p + "seg_std")
            if add_diff:
                out = out.withColumn(p + "minus_seg_mean", finite(F.col(num) - mean))
            if add_ratio:
                out = out.withColumn(p + "to_seg_mean", finite(safe_divide(F.col(num), mean, EPS_FOLDSAFE)))
            if add_zscore:
                out = out.withColumn(p + "seg_zscore", finite(safe_divide(F.col(num) - mean, std, EPS_FOLDSAFE)))
    return out


def smoothed_target_map(fit: DataFrame, cat: str, target: str, smoothing: float, prior) -> DataFrame:
    """(category, te) with ``(sum + prior * m) / (count + m)``; ``prior``
    is a number or a scalar-subquery column."""
    m = F.lit(float(smoothing))
    pr = prior if not isinstance(prior, (int, float)) else F.lit(float(prior))
    return fit.filter(F.col(cat).isNotNull()).groupBy(cat).agg(
        F.coalesce(F.try_divide(F.sum(target) + pr * m, F.count(F.lit(1)) + m), pr).alias("te"))


def foldsafe_target_encoding(fit: DataFrame, transform: DataFrame | None, cat_cols: Sequence[str], target: str,
                             smoothing: float = 20.0, inner_splits: int = 5, order_cols: Sequence[str] = (),
                             label_counts: dict | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """Fit rows get out-of-fold encodings from stratified inner folds
    (totals minus the row's own inner fold: one ``groupBy``, no loop over
    folds); transform rows get the full fit map.  Unseen or missing -> prior,
    the mean target of all fit rows.  Inner folds follow ``order_cols``, by
    default a seeded hash of the whole row without its target (equal rows
    share a fold).  Returns (fit_encoded, transform_encoded).
    """
    prior = fit.select(F.avg(target)).scalar()
    if label_counts is None:
        rare = fit.groupBy(target).count().agg(F.min("count")).first()[0]
    else:
        rare = min(label_counts.values())
    k = max(2, min(inner_splits, int(rare or 0)))
    if order_cols:
        folded = stratified_kfold(fit, target, list(order_cols), k, out="__inner")
    else:
        shuffled = fit.withColumn("__order", hash_order([c for c in fit.columns if c != target], seed))
        folded = stratified_kfold(shuffled, target, ["__order"], k, out="__inner", unique=False).drop("__order")
    # Every category column reads the folded rows three times: place them once.
    folded = cut_lineage(folded)
    m = F.lit(float(smoothing))
    fit_out, tr_out = folded, transform
    for cat in cat_cols:
        name = f"{cat}__foldsafe_te"
        tot = folded.filter(F.col(cat).isNotNull()).groupBy(cat).agg(
            F.sum(target).alias("__s_all"), F.count(F.lit(1)).alias("__n_all"))
        per = folded.filter(F.col(cat).isNotNull()).groupBy(cat, "__inner").agg(
            F.sum(target).alias("__s_f"), F.count(F.lit(1)).alias("__n_f"))
        oof = per.join(tot, cat).select(
            F.col(cat).alias("__c"), F.col("__inner").alias("__i"),
            F.try_divide(F.col("__s_all") - F.col("__s_f") + prior * m, F.col("__n_all") - F.col("__n_f") + m).alias("__te"))
        j = fit_out.join(oof, (fit_out[cat] == oof["__c"]) & (fit_out["__inner"] == oof["__i"]), "left")
        fit_out = j.withColumn(name, F.coalesce("__te", prior)).drop("__c", "__i", "__te")
        if tr_out is not None:
            mp = smoothed_target_map(fit, cat, target, smoothing, prior).withColumnRenamed(cat, "__c")
            j = tr_out.join(mp, tr_out[cat] == mp["__c"], "left")
            tr_out = j.withColumn(name, F.coalesce("te", prior)).drop("__c", "te")
    return fit_out.drop("__inner"), tr_out


def frequency_encoding(frames: Sequence[DataFrame], df: DataFrame, cat: str, out: str, share: bool = False) -> DataFrame:
    """Count (or share) of each category over the union of ``frames``
    (train + test), missing counted as its own value."""
    u = frames[0].select(cat)
    for f in frames[1:]:
        u = u.unionByName(f.select(cat))
    cnt = u.groupBy(cat).agg(F.count(F.lit(1)).alias("__n"))
    if share:
        total = u.select(F.count(F.lit(1))).scalar()
        cnt = cnt.withColumn("__n", F.col("__n") / total)
    cnt = cnt.withColumnRenamed(cat, "__c")
    j = df.join(cnt, df[cat].eqNullSafe(cnt["__c"]), "left")
    return j.withColumn(out, F.col("__n")).drop("__c", "__n")
