"""Category normalisation, crosses and dictionary encoders.

Dictionaries are DataFrames of (value, code) built from distinct values with
dense ranks from bucketed prefix sums (no single-task window), then joined back.
The join is an ordinary equi-join: AQE turns it into a broadcast at runtime
when the dictionary is small, and it stays a sort-merge join when not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import dense_index

MISSING = "__MISSING__"


def normalize(c: str) -> Column:
    """C20: text category, missing -> ``__MISSING__``."""
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def cross(a: str, b: str) -> Column:
    """``a__b`` of the normalised categories."""
    return F.concat_ws("__", normalize(a), normalize(b))


def dictionary(frames: Sequence[DataFrame], c: str, code: str = "code") -> DataFrame:
    """Shared dictionary over the union of ``frames``: distinct non-missing
    values -> 0-based code in value order."""
    vals = frames[0].select(c)
    for f in frames[1:]:
        vals = vals.unionByName(f.select(c))
    return dense_index(vals.filter(F.col(c).isNotNull()).distinct(), c, code)


def ordinal_encode(df: DataFrame, fit_frames: Sequence[DataFrame], c: str, out: str,
                   unseen: int = -1, missing: int | None = -2) -> DataFrame:
    """Codes from ``fit_frames``; unseen -> ``unseen``; missing ->
    ``missing`` (or ``unseen`` when None)."""
    d = dictionary(fit_frames, c, "__code").withColumnRenamed(c, "__v")
    j = df.join(d, df[c] == d["__v"], "left")
    miss = F.lit(unseen if missing is None else missing)
    code = F.when(F.col(c).isNull(), miss).otherwise(F.coalesce(F.col("__code"), F.lit(unseen)))
    return j.select(*df.columns, code.cast("int").alias(out))


def train_codes(df: DataFrame, fit: DataFrame, c: str, out: str) -> DataFrame:
    """Codes from 1 over the fit rows' normalised values, unseen -> 0."""
    fitn = fit.select(normalize(c).alias("__v"))
    d = dictionary([fitn], "__v", "__code")
    j = df.withColumn("__n", normalize(c)).join(d, F.col("__n") == d["__v"], "left")
    return j.select(*df.columns, F.coalesce(F.col("__code") + 1, F.lit(0)).cast("int").alias(out))


def sorted_joined(c: str, sep: str = "|") -> Column:
    """Sorted distinct values joined by ``sep`` (an aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c))), sep)
