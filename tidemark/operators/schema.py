"""Schema rules: feature selection, alignment, roles, manifests
(B01-B05, B08-B11, B13, B14, M03).

Column-list decisions are driver-side list work over ``df.schema`` (no job);
data checks are single aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import scalar as sc

# Drift exclusion sets (B13) by name.
DRIFT_EXCLUSIONS = {
    "all_except_id": [],
    "no_decision_day": ["decision_day"],
    "no_day_cb_offered": ["decision_day", "cb_rate", "offered_rate"],
    "no_day_rate_limits": ["decision_day", "cb_rate", "offered_rate", "overdraft_limit_min", "overdraft_limit_max"],
}


def feature_frame(df: DataFrame, id_col: str, target: str | None, drop: Sequence[str] = (),
                  excluded: Sequence[str] = ()) -> DataFrame:
    """Drop id, date, target and configured exclusions; configs naming
    the id or target as an exclusion are rejected."""
    bad = {id_col, target} & set(excluded)
    if bad:
        raise ValueError(f"excluded_features must not name {sorted(b for b in bad if b)}")
    gone = {id_col, *drop, *excluded} | ({target} if target else set())
    return df.select(*[c for c in df.columns if c not in gone])


def check_aligned(train: DataFrame, test: DataFrame) -> None:
    """Same feature names in the same order (schema only, no job)."""
    if train.columns != test.columns:
        raise ValueError(f"train/test columns differ: {train.columns} vs {test.columns}")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def resolve_columns(columns: Iterable[str], requested: Iterable[str]) -> tuple[list[str], list[str]]:
    """Keep requested columns that exist; return (kept, skipped)."""
    have = set(columns)
    req = list(requested)
    return [c for c in req if c in have], [c for c in req if c not in have]


def confident_rows(df: DataFrame, score: str, hi: float, lo: float, out: str = "pseudo_target") -> DataFrame:
    """Rows scored above ``hi`` or below ``lo``; hard label score > 0.5."""
    p = F.col(score)
    return df.filter((p > hi) | (p < lo)).withColumn(out, (p > 0.5).cast("int"))


def usable_columns(df: DataFrame, cols: Sequence[str], target: str, min_rows: int = 100) -> DataFrame:
    """Columns with at least ``min_rows`` present values and both classes
    among those rows - one unpivot, one aggregate for all columns."""
    long = df.select(target, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [target], list(cols), "column_name", "x")
    return (long.filter(F.col("x").isNotNull()).groupBy("column_name")
            .agg(F.count("x").alias("n_present"), F.countDistinct(target).alias("__k"))
            .filter((F.col("n_present") >= min_rows) & (F.col("__k") == 2)).drop("__k"))


def split_feature_space(columns: Sequence[str], offer_cols: Sequence[str], context_markers: Sequence[str] = ("context",)) -> tuple[list[str], list[str]]:
    """Absolute columns vs context-relative columns; offer terms are in both."""
    ctx = [c for c in columns if any(m in c for m in context_markers)]
    absolute = [c for c in columns if c not in ctx]
    relative = list(dict.fromkeys([*offer_cols, *ctx]))
    return absolute, relative


def feature_variants(numeric: Sequence[str], categorical: Sequence[str], day: str, fit: DataFrame,
                     row_id: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Named feature families, each a function frame -> frame with extra
    columns.  The frame holds the rows of both sides (train and test), over
    which frequencies and bins are counted; ``fit`` gives the first day.

    ``quantile_bins`` leaves out columns with missing values, and
    ``all_label_free`` is every family but the calendar."""
    from ..functions import calendar as cal
    from ..functions import categorical as catf
    from .encoders import frequency_encoding
    from .ranks import equal_count_bins, is_complete

    def base(df):
        return df

    def log(df):
        return df.select("*", *[sc.signed_log1p(c).alias(f"{c}_slog") for c in numeric])

    def zero_flags(df):
        return df.select("*", *[sc.zero_flag(c).alias(f"{c}_is_zero") for c in numeric],
                         sc.missing_count(list(numeric)).alias("n_missing_numeric"))

    def frequency(df):
        for c in categorical:
            df = frequency_encoding([df], df, c, f"{c}_combined_freq")
        return df

    def quantile_bins(df):
        for c in numeric:
            if is_complete(df, c):
                df = equal_count_bins(df, c, row_id, f"{c}_qbin16", 16)
        return df

    def cat_interactions(df):
        pairs = [(a, b) for i, a in enumerate(categorical) for b in categorical[i + 1:]]
        return df.select("*", *[catf.cross(a, b).alias(f"{a}__x__{b}") for a, b in pairs])

    def time_regime(df):
        return df.select("*", *cal.calendar_columns(day, fit, "time_all"))

    def all_label_free(df):
        for family in (log, zero_flags, frequency, quantile_bins, cat_interactions):
            df = family(df)
        return df

    return {f.__name__: f for f in (base, log, zero_flags, frequency, quantile_bins, cat_interactions, time_regime, all_label_free)}


def check_target(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Target present in train only and its values exactly {0, 1}.
    Returns a (check, passed, detail) table."""
    in_train = target in train.columns
    in_test = target in test.columns
    is0, is1 = F.col(target) == 0, F.col(target) == 1
    vals = train.agg(F.count_if(is0).alias("n0"), F.count_if(is1).alias("n1"),
                     F.count_if(F.col(target).isNotNull() & ~is0 & ~is1).alias("other")) if in_train else None
    s = train.sparkSession
    rows = [("target_in_train", in_train, ""), ("target_not_in_test", not in_test, "")]
    base = s.createDataFrame(rows, "check string, passed boolean, detail string")
    if vals is None:
        return base
    seen = F.concat_ws(",", F.when(F.col("n0") > 0, "0"), F.when(F.col("n1") > 0, "1"), F.when(F.col("other") > 0, "other"))
    v = vals.select(F.lit("target_values_binary").alias("check"),
                    ((F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("other") == 0)).alias("passed"),
                    seen.alias("detail"))
    return base.unionByName(v)
