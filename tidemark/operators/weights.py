"""Label-free sample weights.

Every strategy is a column expression over the day plus 1-row fit statistics
(scalar subqueries), then mean-normalised and validated with one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..operators.ranks import join_back


def linear_recency(df: DataFrame, day: str, min_weight: float = 0.5, max_weight: float = 1.5) -> Column:
    """``min + (day - first) / max(span, 1) * (max - min)``."""
    lo = df.select(F.min(day)).scalar()
    hi = df.select(F.max(day)).scalar()
    span = F.greatest(F.datediff(hi, lo), F.lit(1)).cast("double")
    rec = F.datediff(F.col(day), lo).cast("double") / span
    return F.lit(min_weight) + rec * F.lit(max_weight - min_weight)


def exponential_recency(df: DataFrame, day: str, half_life_days: float = 120.0, floor: float = 0.25) -> Column:
    """``max(0.5 ** (age / half_life), floor)``, age in days from the last
    day; a missing day has a missing weight, which :func:`validate` rejects."""
    hi = df.select(F.max(day)).scalar()
    age = F.datediff(hi, F.col(day)).cast("double")
    return F.when(F.col(day).isNotNull(), F.greatest(F.pow(F.lit(0.5), age / F.lit(half_life_days)), F.lit(floor)))


def recent_boost(day: str, cutoff: str, recent_weight: float = 2.0, older_weight: float = 1.0) -> Column:
    """Two levels around a cutoff; a missing day has a missing weight."""
    recent = F.col(day) >= F.lit(cutoff).cast("date")
    return F.when(recent, F.lit(recent_weight)).when(~recent, F.lit(older_weight))


def class_balance(df: DataFrame, label: str, mode: str = "balanced") -> Column:
    """Positive-class weight ``neg/pos`` (balanced), its square root, or 1."""
    pos = df.select(F.sum(label)).scalar().cast("double")
    neg = df.select(F.sum(1 - F.col(label))).scalar().cast("double")
    if mode == "none":
        ratio = F.lit(1.0)
    elif mode == "sqrt":
        ratio = F.sqrt(neg / pos)
    elif mode == "balanced":
        ratio = neg / pos
    else:
        raise ValueError(f"unknown class weight mode {mode}")
    return F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0))


def normalize_mean(df: DataFrame, w: str, out: str | None = None) -> DataFrame:
    """Divide by the mean weight."""
    mean = df.select(F.avg(w)).scalar()
    return df.withColumn(out or w, F.col(w) / mean)


def validate(df: DataFrame, w: str) -> None:
    """Raise when any weight is missing, infinite or not positive,
    or the mean is not a positive finite number (one aggregate)."""
    x = F.col(w)
    row = df.agg(
        F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"),
        F.count_if(x <= 0).alias("nonpos"),
        F.avg(x).alias("mean"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} sample weights are missing or infinite")
    if row["nonpos"]:
        raise ValueError(f"{row['nonpos']} sample weights are not positive")
    if row["mean"] is None or not (row["mean"] > 0):
        raise ValueError("sample weights have an invalid mean")


def sample_weights(df: DataFrame, day: str, cfg: dict | None, id_col: str = "front_id",
                   weight_file: DataFrame | None = None, out: str = "sample_weight") -> DataFrame | None:
    """Config-driven weights (J01-J05); None when disabled."""
    if not cfg or not cfg.get("enabled", False):
        return None
    strategy = cfg.get("strategy")
    if strategy == "linear_recency":
        res = df.withColumn(out, linear_recency(df, day, cfg.get("min_weight", 0.5), cfg.get("max_weight", 1.5)))
    elif strategy == "exponential_recency":
        res = df.withColumn(out, exponential_recency(df, day, cfg.get("half_life_days", 120.0), cfg.get("min_weight", 0.25)))
    elif strategy == "recent_period_boost":
        res = df.withColumn(out, recent_boost(day, cfg["cutoff"], cfg.get("recent_weight", 2.0), cfg.get("older_weight", 1.0)))
    elif strategy == "adversarial_file":
        if weight_file is None:
            raise ValueError("adversarial_file strategy needs a weight table")
        res = weights_from_table(df, weight_file, id_col, out)
    else:
        raise ValueError(f"Unsupported sample weight strategy: {strategy}")
    if cfg.get("normalize_mean", True):
        res = normalize_mean(res, out)
    validate(res, out)
    return res


def weights_from_table(df: DataFrame, weights: DataFrame, id_col: str, out: str = "sample_weight") -> DataFrame:
    """Key -> weight lookup; raises when any key has no weight."""
    w = weights.select(id_col, F.col("sample_weight").cast("double").alias(out))
    res = join_back(df, w, [id_col], how="left")
    missing = res.agg(F.count_if(F.col(out).isNull())).first()[0]
    if missing:
        raise ValueError(f"{missing} ids have no weight")
    return res


def density_ratio(p: Column, clip_eps: float = 0.01) -> Column:
    """J06 step 1: clipped odds ``p / (1 - p)``; missing stays missing."""
    pc = clip(p, clip_eps, 1 - clip_eps)
    return pc / (1 - pc)


def density_ratio_weights(df: DataFrame, p: str, clip_eps: float = 0.01, max_weight: float = 10.0,
                          out: str = "sample_weight") -> DataFrame:
    """Odds, mean-normalised, capped, re-normalised (two 1-row passes);
    a missing probability fails the job when its row is evaluated."""
    given = F.when(F.col(p).isNull() | F.isnan(p), F.raise_error(F.lit("a probability is missing")).cast("double")).otherwise(F.col(p))
    r = df.withColumn("__r", density_ratio(given, clip_eps))
    m1 = r.select(F.avg("__r")).scalar()
    c = r.withColumn("__c", F.least(F.col("__r") / m1, F.lit(max_weight)))  # no missing odds here
    m2 = c.select(F.avg("__c")).scalar()
    return c.withColumn(out, F.col("__c") / m2).drop("__r", "__c")


def constant_weight(value: float) -> Column:
    """Constant weight for pseudo-labelled rows."""
    return F.lit(float(value))
