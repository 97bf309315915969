"""Data-quality profile of a train / test pair (B03, E01-E07, E09, F07-F09,
M02, H05).

Every per-column report is one pass: a wide aggregate (or an unpivot to
``(side, column, value)`` followed by one ``groupBy``) instead of a loop of
jobs over columns.  Distinct counts include missing as one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ranks import join_back


def tagged_union(train: DataFrame, test: DataFrame, side: str = "side") -> DataFrame:
    """Train rows tagged 0, test rows tagged 1 (missing columns -> null)."""
    return train.withColumn(side, F.lit(0)).unionByName(test.withColumn(side, F.lit(1)), allowMissingColumns=True)


def _long(df: DataFrame, cols: Sequence[str], side: str, cast: str) -> DataFrame:
    return df.select(side, *[F.col(c).cast(cast).alias(c) for c in cols]).unpivot([side], list(cols), "column_name", "v")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class (missing kept as its own class) and share."""
    n = df.select(F.count(F.lit(1))).scalar()
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("share", F.col("n_rows") / n)


def distinct_counts(both: DataFrame, cols: Sequence[str], side: str = "side", approx_rsd: float | None = None) -> DataFrame:
    """Per column and side, distinct values counting missing as one value.
    One unpivot + one two-phase distinct aggregate for all columns; with
    ``approx_rsd`` a HyperLogLog++ sketch per column (one wide aggregate, no
    unpivot shuffle) replaces the exact count at scale."""
    if approx_rsd is not None:
        aggs = []
        for c in cols:
            aggs.append((F.approx_count_distinct(c, approx_rsd) + F.max(F.col(c).isNull().cast("int"))).alias(c))
        wide = both.groupBy(side).agg(*aggs).unpivot([side], list(cols), "column_name", "nunique")
        return wide.groupBy("column_name").pivot(side, [0, 1]).agg(F.first("nunique")).select(
            "column_name", F.col("0").alias("train_nunique"), F.col("1").alias("test_nunique"))
    long = _long(both, cols, side, "string")
    g = long.groupBy("column_name", side).agg(
        (F.countDistinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("nunique"))
    return g.groupBy("column_name").pivot(side, [0, 1]).agg(F.first("nunique")).select(
        "column_name", F.col("0").alias("train_nunique"), F.col("1").alias("test_nunique"))


def missing_rates(both: DataFrame, cols: Sequence[str], side: str = "side") -> DataFrame:
    """Missing rate per column on each side and the difference."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]
    wide = both.groupBy(side).agg(*aggs)
    long = wide.unpivot([side], list(cols), "column_name", "rate")
    p = long.groupBy("column_name").pivot(side, [0, 1]).agg(F.first("rate"))
    return p.select("column_name", F.col("0").alias("train_missing_rate"), F.col("1").alias("test_missing_rate"),
                    (F.col("1") - F.col("0")).alias("test_minus_train"))


def numeric_ranges(both: DataFrame, cols: Sequence[str], side: str = "side") -> DataFrame:
    """Min / max / mean / sample std per numeric column and side."""
    long = _long(both, cols, side, "double")
    g = long.groupBy("column_name", side).agg(F.min("v").alias("mn"), F.max("v").alias("mx"),
                                         F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    p = g.groupBy("column_name").pivot(side, [0, 1]).agg(F.first("mn").alias("min"), F.first("mx").alias("max"),
                                                     F.first("mean").alias("mean"), F.first("std").alias("std"))
    ren = {f"{s}_{k}": f"{'train' if s == 0 else 'test'}_{k}" for s in (0, 1) for k in ("min", "max", "mean", "std")}
    return p.select("column_name", *[F.col(a).alias(b) for a, b in ren.items()])


def date_profile(both: DataFrame, day_text: str, side: str = "side") -> DataFrame:
    """Per side missing, parse failures, distinct (missing counted), min, max."""
    parsed = F.expr(f"try_cast(`{day_text}` as date)")
    d = both.select(side, F.col(day_text).alias("raw"), parsed.alias("day"))
    return d.groupBy(side).agg(
        F.count_if(F.col("raw").isNull()).alias("missing"),
        F.count_if(F.col("day").isNull() & F.col("raw").isNotNull()).alias("parse_failures"),
        (F.countDistinct("raw") + F.max(F.col("raw").isNull().cast("int"))).alias("nunique"),
        F.min("day").alias("min"), F.max("day").alias("max"))


def day_overlap(both: DataFrame, day: str, side: str = "side") -> DataFrame:
    """Shared / train-only / test-only distinct days (full outer join of
    the two distinct-day sets)."""
    tr = both.filter(F.col(side) == 0).select(F.col(day).alias("d")).distinct().withColumn("t", F.lit(1))
    te = both.filter(F.col(side) == 1).select(F.col(day).alias("d")).distinct().withColumn("s", F.lit(1))
    j = tr.join(te, "d", "full_outer")
    return j.agg(F.count_if(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("shared_days"),
                 F.count_if(F.col("s").isNull()).alias("train_only_days"),
                 F.count_if(F.col("t").isNull()).alias("test_only_days"))


def monthly(both: DataFrame, day: str, target: str, side: str = "side") -> DataFrame:
    """Rows and target rate per (side, month); rate is missing on test."""
    m = F.date_format(F.col(day), "yyyy-MM").alias("month")
    return both.groupBy(side, m).agg(F.count(F.lit(1)).alias("rows"), F.avg(target).alias("target_rate"))


def category_prevalence(df: DataFrame, cat: str, target: str, top: int = 15) -> DataFrame:
    """Per category positive rate and size; the ``top`` highest rates
    (ties by category) - a top-k, the limit is the feature."""
    from ..functions.categorical import normalize

    g = df.groupBy(normalize(cat).alias(cat)).agg(F.avg(target).alias("rate"), F.count(F.lit(1)).alias("n_rows"))
    return g.orderBy(F.desc("rate"), F.asc(cat)).limit(top)


def duplicate_summary(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], target: str) -> DataFrame:
    """E09 + F07: duplicates by grouping on the feature columns themselves
    (null-safe, no hash collisions).  One grouping of the tagged union per
    signature (whole row; feature columns) gives both sides' counts, and two
    1-row aggregates sum them up."""
    fc = list(feature_cols)
    extra = [c for c in train.columns if c not in test.columns]  # the target
    both = tagged_union(train, test, "__side")
    rows = lambda side: F.count_if(F.col("__side") == side)
    whole = both.groupBy(*test.columns, *extra, "__side").agg(F.count(F.lit(1)).alias("n")).agg(
        *[F.coalesce(F.sum(F.when(F.col("__side") == k, F.col("n") - 1)), F.lit(0)).alias(f"{s}_full_duplicate_rows") for k, s in enumerate(("train", "test"))])
    g = both.groupBy(*fc).agg(rows(0).alias("t"), rows(1).alias("e"), F.min(target).alias("lo"), F.max(target).alias("hi"))
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    conflict = (F.col("t") > 1) & (F.col("lo") < F.col("hi"))
    shared = (F.col("t") > 0) & (F.col("e") > 0)
    sums = g.agg(
        total("t", F.col("t") > 1).alias("train_duplicate_feature_rows"), F.count_if(conflict).alias("train_conflicting_groups"),
        total("t", conflict).alias("train_conflicting_rows"), total("e", F.col("e") > 1).alias("test_duplicate_feature_rows"),
        F.count_if(shared).alias("shared_signatures"), total("t", shared).alias("train_rows_shared"), total("e", shared).alias("test_rows_shared"))
    return sums.select(*[whole.select(F.col(c).cast("long")).scalar().alias(c) for c in whole.columns], *[F.col(c).cast("long").alias(c) for c in sums.columns])


def categorical_overlap(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """per categorical column, distinct non-missing values per side, test
    values unseen in train (count and sorted list), missing counts and rates."""
    both = tagged_union(train.select(*cols), test.select(*cols))
    long = _long(both, cols, "side", "string")
    stats = long.groupBy("column_name").agg(
        F.countDistinct(F.when(F.col("side") == 0, F.col("v"))).alias("train_nunique_non_null"),
        F.countDistinct(F.when(F.col("side") == 1, F.col("v"))).alias("test_nunique_non_null"),
        F.count_if((F.col("side") == 0) & F.col("v").isNull()).alias("missing_train"),
        F.count_if((F.col("side") == 1) & F.col("v").isNull()).alias("missing_test"),
        F.avg(F.when(F.col("side") == 0, F.col("v").isNull().cast("double"))).alias("missing_rate_train"),
        F.avg(F.when(F.col("side") == 1, F.col("v").isNull().cast("double"))).alias("missing_rate_test"),
    )
    vals = long.filter(F.col("v").isNotNull()).select("column_name", "side", "v").distinct()
    unseen = vals.filter(F.col("side") == 1).join(vals.filter(F.col("side") == 0), ["column_name", "v"], "left_anti")
    u = unseen.groupBy("column_name").agg(F.count(F.lit(1)).alias("unseen_in_test_count"),
                                     F.array_join(F.array_sort(F.collect_list("v")), "|").alias("unseen_in_test_values"))
    out = stats.join(u, "column_name", "left")
    return out.select(*stats.columns, F.coalesce("unseen_in_test_count", F.lit(0).cast("long")).alias("unseen_in_test_count"),
                      F.coalesce("unseen_in_test_values", F.lit("")).alias("unseen_in_test_values"))


def id_set_report(sets: dict[str, DataFrame], id_col: str) -> DataFrame:
    """distinct ids tagged by set -> one row per membership pattern with
    its id count (overlaps and differences of any number of sets)."""
    names = list(sets)
    tagged = None
    for n in names:
        t = sets[n].select(id_col).distinct().withColumn("set", F.lit(n))
        tagged = t if tagged is None else tagged.unionByName(t)
    flags = [F.max((F.col("set") == n).cast("int")).cast("boolean").alias(f"in_{n}") for n in names]
    per = tagged.groupBy(id_col).agg(*flags)
    return per.groupBy(*[f"in_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n_ids"))


def ordered_equal(a: DataFrame, b: DataFrame, id_col: str, pos: str = "pos") -> DataFrame:
    """Two ordered id lists are equal when every (pos, id) pair matches;
    a join on (pos, id) and three counts."""
    m = a.select(pos, id_col).join(b.select(pos, id_col), [pos, id_col])
    na = a.select(F.count(F.lit(1))).scalar()
    nb = b.select(F.count(F.lit(1))).scalar()
    return m.agg(F.count(F.lit(1)).alias("matched")).select(
        F.col("matched"), na.alias("n_a"), nb.alias("n_b"),
        ((F.col("matched") == na) & (na == nb)).alias("same_order"))


def sample_status(test: DataFrame, sample: DataFrame, id_col: str, pos: str = "pos") -> DataFrame:
    """PASS / HOLD / BLOCK state of the sample-to-test mapping.

    ``pos`` is the stored row position of each table.  The test block of the
    sample must hold every test id, in test order; extra ids give HOLD.
    """
    s_in = sample.join(test.select(id_col), id_col, "left_semi")
    # Order of the sample rows that are in test, renumbered by position.
    from .ranks import prefix_sums

    s_ord = prefix_sums(s_in.select(pos, id_col).withColumn("__one", F.lit(1)), [], [pos], ["__one"]).select(
        F.col("__one_before").alias("__k"), id_col)
    t_ord = prefix_sums(test.select(pos, id_col).withColumn("__one", F.lit(1)), [], [pos], ["__one"]).select(
        F.col("__one_before").alias("__k"), id_col)
    matched = s_ord.join(t_ord, ["__k", id_col]).select(F.count(F.lit(1))).scalar()
    n_test = test.select(F.countDistinct(id_col)).scalar()
    n_s_in = s_in.select(F.count(F.lit(1))).scalar()
    test_minus = test.join(sample.select(id_col), id_col, "left_anti").select(F.count(F.lit(1))).scalar()
    sample_minus = sample.join(test.select(id_col), id_col, "left_anti").select(F.countDistinct(id_col)).scalar()
    same_order = (matched == n_test) & (n_s_in == n_test)
    status = (F.when((test_minus == 0) & same_order & (sample_minus == 0), "PASS_SAMPLE_MATCHES_TEST")
              .when((test_minus == 0) & same_order, "HOLD_SAMPLE_CONTAINS_EXTRA_IDS_BUT_TEST_BLOCK_IS_ALIGNED")
              .otherwise("BLOCK_SAMPLE_TEST_MAPPING_UNCLEAR"))
    return test.sparkSession.range(1).select(
        test_minus.alias("test_minus_sample_ids"), sample_minus.alias("sample_minus_test_ids"),
        same_order.alias("same_order"), status.alias("status"))


def schema_report(train: DataFrame, test: DataFrame, roles: dict[str, str], id_col: str, target: str) -> DataFrame:
    """Per column role, presence, types, missing rate and distinct count
    (missing counted) on each side; stats from E02/E03 in one job each."""
    s = train.sparkSession
    cols = list(dict.fromkeys([*train.columns, *test.columns]))
    ttype = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    stype = {f.name: f.dataType.simpleString() for f in test.schema.fields}
    meta = s.createDataFrame(
        [(c, roles.get(c, "numeric_feature_candidate" if c in stype else "feature"), c in ttype, c in stype,
          ttype.get(c, ""), stype.get(c, "")) for c in cols],
        "column_name string, role_initial string, in_train boolean, in_test boolean, train_dtype string, test_dtype string")
    both = tagged_union(train, test)
    mr = missing_rates(both, cols)
    nu = distinct_counts(both, cols)
    return meta.join(mr.select("column_name", "train_missing_rate", "test_missing_rate"), "column_name", "left").join(
        nu, "column_name", "left")


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]
