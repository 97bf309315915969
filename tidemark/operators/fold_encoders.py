"""Segment statistics and target encodings of all folds in one pass.

Rows are first summed to one row per (column, category, day): counts and sums
of the target and of every numeric.  That table has at most categories times
days rows, so the train days of every fold or window are added up from it, not
from the rows; no fold is a job of its own.  Out-of-fold encodings of train
rows take their inner folds from one prefix pass keyed by fold.

The sums are those of values less the column's overall mean, so that standard
deviations don't cancel.  Categories meet their statistics on (fold,
category), one join per category column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPS_FOLDSAFE, finite, safe_divide
from ..session import cut_lineage
from .ranks import deal, prefix_sums
from .splits import assign_folds


def day_stats(df: DataFrame, cats: Sequence[str], nums: Sequence[str], day: str, target: str) -> tuple[DataFrame, dict[str, float]]:
    """(column_name, category, day, rows and sums) over rows with a category, and the means that were taken off the numerics."""
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in nums]).first()
    centre = {c: float(first[c] or 0.0) for c in nums}
    named = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in cats])
    off = {c: F.col(c).cast("double") - F.lit(centre[c]) for c in nums}
    long = df.select(day, target, *[off[c].alias(c) for c in nums], F.explode(named).alias("__e")).select("*", "__e.*").filter(F.col("category").isNotNull())
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(target).cast("double").alias("y")]
    for c in nums:
        sums += [F.count(c).alias(f"{c}__n"), F.sum(c).alias(f"{c}__s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}__q")]
    return long.groupBy("column_name", "category", day).agg(*sums), centre


def fold_stats(days: DataFrame, centre: dict[str, float], spec: list[dict], day: str, min_count: int = 20) -> DataFrame:
    """Per (fold, column_name, category): train rows ``rows``, their target sum
    ``y``, and per numeric mean, sample std and count (missing below
    ``min_count``), for every fold or window of ``spec``."""
    train = assign_folds(days, day, spec).filter("role = 'train'")
    add = [c for c in days.columns if c not in ("column_name", "category", day)]
    tot = train.groupBy("fold", "column_name", "category").agg(*[F.sum(c).alias(c) for c in add])
    out = [F.col("fold"), F.col("column_name"), F.col("category"), F.col("rows"), F.col("y")]
    for c, mean in centre.items():
        n, s, q = (F.col(f"{c}__{k}") for k in "nsq")
        enough = n >= min_count
        spread = F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
        out += [F.when(enough, s / n + F.lit(mean)).alias(f"{c}__mean"), F.when(enough, spread).alias(f"{c}__std"), F.when(enough, n).alias(f"{c}__count")]
    return tot.select(*out)


def add_fold_features(member: DataFrame, stats: DataFrame, cats: Sequence[str], nums: Sequence[str], te_cats: Sequence[str], target: str,
                      order: str, smoothing: float = 50.0, inner_splits: int = 5) -> DataFrame:
    """``member`` (rows with ``fold`` and ``role``) plus E14 features of
    ``cats`` x ``nums`` and the target encodings of ``te_cats``: the fold's
    map for valid rows, out-of-fold values for train rows.  ``order`` names a
    column, unique in a fold, whose order deals the inner folds."""
    train = member.filter("role = 'train'")
    priors = train.groupBy("fold").agg(F.avg(target).alias("__prior"))
    rare = train.groupBy("fold", target).count().groupBy("fold").agg(F.greatest(F.lit(2), F.least(F.lit(inner_splits), F.min("count"))).alias("__k"))
    # One short row per fold, as a map: rows stay where they are.
    per_fold = priors.join(rare, "fold").agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("__prior", "__k"))))).scalar()
    placed = prefix_sums(train.withColumn("__one", F.lit(1)), ["fold", target], [order], ["__one"], unique=True)
    placed = placed.select(*member.columns, (F.col("__one_before") % F.element_at(per_fold, F.col("fold"))["__k"]).cast("int").alias("__inner"))
    placed = placed.unionByName(member.filter("role = 'valid'").withColumn("__inner", F.lit(None).cast("int")))
    # The joins below add many columns to a task's rows, so their number follows the rows.
    placed = cut_lineage(deal(placed, member.count(), order))
    out, m = placed, F.lit(float(smoothing))
    prior = F.element_at(per_fold, F.col("fold"))["__prior"]
    for c in dict.fromkeys([*cats, *te_cats]):
        own = stats.filter(F.col("column_name") == c).select(F.col("fold").alias("__f"), F.col("category").alias("__c"), F.col("rows").alias("__rows"), F.col("y").alias("__y"),
                                                             *[F.col(f"{n}__{k}").alias(f"{c}__{n}__seg_{k}") for n in (nums if c in cats else ()) for k in ("mean", "std", "count")])
        out = out.join(own, (out["fold"] == own["__f"]) & (out[c].cast("string") == own["__c"]), "left").drop("__f", "__c")
        if c in cats:
            for n in nums:
                p = f"{c}__{n}__"
                mean, std = F.col(f"{p}seg_mean"), F.col(f"{p}seg_std")
                out = out.withColumn(f"{p}minus_seg_mean", finite(F.col(n) - mean)).withColumn(
                    f"{p}to_seg_mean", finite(safe_divide(F.col(n), mean, EPS_FOLDSAFE))).withColumn(
                    f"{p}seg_zscore", finite(safe_divide(F.col(n) - mean, std, EPS_FOLDSAFE)))
        if c in te_cats:
            inner = placed.filter(F.col("__inner").isNotNull() & F.col(c).isNotNull()).groupBy(
                F.col("fold").alias("__f"), F.col(c).alias("__c"), F.col("__inner").alias("__i")).agg(
                F.sum(target).cast("double").alias("__yi"), F.count(F.lit(1)).alias("__ni"))
            out = out.join(inner, (out["fold"] == inner["__f"]) & (out[c] == inner["__c"]) & (out["__inner"] == inner["__i"]), "left").drop("__f", "__c", "__i")
            y, n = F.col("__y") - F.coalesce("__yi", F.lit(0.0)), F.col("__rows") - F.coalesce("__ni", F.lit(0))
            out = out.withColumn(f"{c}__foldsafe_te", F.coalesce(F.try_divide(y + prior * m, n + m), prior)).drop("__yi", "__ni")
        out = out.drop("__rows", "__y")
    return out.drop("__inner")
