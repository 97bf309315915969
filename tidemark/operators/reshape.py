"""Set operators and reshaping.

``tagged_union`` (G01) lives in :mod:`profile`.  Prediction sets are one long
table keyed by fold / holdout, so the per-fold concatenation of the
reference (G02) is not needed; summary rows are appended by union (G03).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import join_back, prefix_sums


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "column_name",
                 value: str = "value") -> DataFrame:
    """Wide -> long (values cast to a common type by ``unpivot``)."""
    return df.unpivot(list(ids), list(values), name, value)


def duplicate_members(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose ``keys`` occur more than once, with the copy count and
    an after-first flag (first by ``order``).  Counts come from a partial
    aggregate and positions from bucketed prefix sums, so one key
    holding many copies is not sent to a single task."""
    keys, order = list(keys), list(order)
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies")).filter(F.col("n_copies") > 1)
    dup = join_back(df, cnt, keys, how="inner")
    pos = prefix_sums(dup.withColumn("__one", F.lit(1)), keys, order, ["__one"])
    return pos.select(*dup.columns, (F.col("__one_before") > 0).alias("after_first"))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows after the first of each duplicate group: count(*) - count(distinct)."""
    cols = list(cols or df.columns)
    return df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def append_summary(metrics: DataFrame, key: str, value: str, label: str, agg) -> DataFrame:
    """Append one summary row (e.g. MEAN) computed by ``agg`` over ``value``."""
    s = metrics.agg(agg(F.col(value)).alias(value)).select(F.lit(label).alias(key), value)
    return metrics.select(F.col(key).cast("string").alias(key), value).unionByName(s)


def augment(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows (e.g. pseudo-labelled) by name."""
    return base.unionByName(extra, allowMissingColumns=True)
