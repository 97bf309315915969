"""Ranks and prefix sums without a single-task window.

A window with no (or a low-cardinality) ``partitionBy`` moves every row of a
group to one task.  :func:`prefix_sums` computes "sum of a column over all
rows of my group whose order key is strictly smaller" in bounded pieces:

1. a bucket id ``b`` - the number of boundary values of the order column at
   or below the row's value.  The boundaries are the ``BUCKETS - 1`` distinct
   values with the smallest hash, one scalar subquery of the same plan, so
   they spread like the values, every evaluation finds the same ones and no
   job runs on the driver; a binary search over them gives ``b``;
2. a window over ``(keys, b)`` gives the sum inside the bucket;
3. per-bucket totals (``BUCKETS x groups`` rows at most) give each bucket its
   offset with a small window, joined back on ``(keys, b)``.

A multi-column order is handled lexicographically: the prefix over the
distinct values of the first column, plus the prefix inside each tie on the
remaining columns, so a value holding a third of all rows is still split.
A missing order value sorts after all others.  The plan is the same for
every input size; ``BUCKETS`` is no function of the shuffle partitions.

Used by exact AUC (E21), average / ordinal rank percentiles (D03, D06-D08),
equal-count bins (D09), positions (G05, H05, I04, I05) and dense ids (C26).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET = "__bkt"

#: Buckets of the order column, a power of two.
BUCKETS = 2048


#: Rows of one task where the number of tasks follows the rows.
TASK_ROWS = 200_000


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` rows need, so that a
    task's share doesn't grow with the table; at least the shuffle partitions."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(tasks, *keys)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition that treats missing as equal to missing (``<=>``)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` with null-safe equality; keeps one copy of the keys."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_back needs at least one key")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"__r_{k}"])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return out
    return out.drop(*[f"__r_{k}" for k in keys])


def _boundaries(df: DataFrame, x: str) -> Column:
    """Sorted distinct boundary values: ``BUCKETS - 1`` rows in hash order (at
    most that many per task and in the result), as a scalar subquery.  The
    hash reads every column, so the subquery needs the same shuffle of ``df``
    as the query around it and reuses it."""
    few = df.orderBy(F.xxhash64(*df.columns), x).limit(BUCKETS - 1)
    return few.agg(F.sort_array(F.collect_set(x))).scalar()


def with_buckets(df: DataFrame, x: str) -> DataFrame:
    """``df`` plus the bucket of ``x``, a column named ``BUCKET``: the number
    of boundaries <= x by binary search; a missing x goes last.

    Each halving is a projection of its own, so the search is compiled with
    the rest of the stage; a higher-order function would be interpreted, and
    one expression written out would double with every step.
    """
    out = df.withColumn("__bounds", _boundaries(df, x)).withColumn(BUCKET, F.lit(0))
    for i in range(BUCKETS.bit_length() - 2, -1, -1):
        beyond = F.get(F.col("__bounds"), F.col(BUCKET) + ((1 << i) - 1)) <= F.col(x)
        out = out.withColumn(BUCKET, F.col(BUCKET) + F.when(beyond, 1 << i).otherwise(0))
    return out.withColumn(BUCKET, F.when(F.col(x).isNull(), F.lit(BUCKETS)).otherwise(F.col(BUCKET))).drop("__bounds")


def _unique_prefix(df: DataFrame, keys: list[str], x: str, sums: list[str]) -> DataFrame:
    """Prefix sums when ``x`` is unique inside each ``keys`` group."""
    dfb = with_buckets(df, x)
    w_local = Window.partitionBy(*keys, BUCKET).orderBy(F.col(x).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    local = dfb.select("*", *[F.coalesce(F.sum(c).over(w_local), F.lit(0)).alias(f"__loc_{c}") for c in sums])
    totals = dfb.groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(f"__tot_{c}") for c in sums])
    w_off = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    w_grp = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"__tot_{c}").over(w_off), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.sum(f"__tot_{c}").over(w_grp).alias(f"__all_{c}") for c in sums])
    joined = join_back(local, offsets, keys + [BUCKET], how="inner") if keys else local.join(offsets, BUCKET)
    return joined.select(*df.columns, *[(F.col(f"__loc_{c}") + F.col(f"__off_{c}")).alias(f"{c}_before") for c in sums],
                         *[F.col(f"__all_{c}").alias(f"{c}_total") for c in sums])


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    unique: bool = False,
    _depth: int = 0,
) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows of the same ``keys`` group
    whose ``order`` tuple is strictly smaller, for every ``c`` in ``sums``
    (and, with ``unique=True``, ``<c>_total`` = the group's sum).

    ``unique=True`` promises the (single) order column is unique inside each
    group, which skips the tie handling.  ``keys`` may contain nulls; they
    form their own group.  A missing order value counts as the largest.
    """
    keys, order, sums = list(keys), list(order), list(sums)
    x, rest = order[0], order[1:]
    if unique and not rest:
        return _unique_prefix(df, keys, x, sums)
    # Rows strictly below on the first column: prefix over its distinct values.
    dist = df.groupBy(*keys, x).agg(*[F.sum(c).alias(c) for c in sums])
    tag = f"__b{_depth}_"
    below = _unique_prefix(dist, keys, x, sums).select(*keys, x, *[F.col(f"{c}_before").alias(f"{tag}{c}") for c in sums])
    out = join_back(df, below, keys + [x], how="left")
    if rest:
        # Rows tied on the first column and below on the remaining ones.
        out = prefix_sums(out, keys + [x], rest, sums, _depth=_depth + 1)
        return out.select(*df.columns, *[(F.col(f"{tag}{c}") + F.col(f"{c}_before")).alias(f"{c}_before") for c in sums])
    return out.select(*df.columns, *[F.col(f"{tag}{c}").alias(f"{c}_before") for c in sums])


def average_rank_pct(
    df: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Percent rank with average ties inside ``keys`` groups.

    ``(rows below + (ties + 1) / 2) / non-missing rows``; a missing value keeps
    a missing rank and does not count.  Equal to pandas
    ``rank(method='average', pct=True)``.
    """
    keys = list(keys)
    dist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__cnt"))
    )
    pref = prefix_sums(dist, keys, [value], ["__cnt"], unique=True)
    pref = pref.withColumnRenamed("__cnt_total", "__n")
    ranks = pref.select(
        *keys, value,
        ((F.col("__cnt_before") + (F.col("__cnt") + 1) / 2.0) / F.col("__n")).alias(out),
    )
    return join_back(df, ranks, keys + [value], how="left")


def average_rank_pct_multi(
    df: DataFrame,
    values: Sequence[str],
    outs: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """:func:`average_rank_pct` for several columns with one prefix pass:
    the columns are unpivoted to (keys, name, value) so all distinct-value
    counts share one shuffle and one window.  The ranks are stored once
    (reliable checkpoint), then joined back per column on (keys, value)."""
    keys = list(keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__v"))
                                for v in values])).alias("__p")
    long = df.select(*keys, pairs).select(*keys, "__p.__name", "__p.__v").filter(F.col("__v").isNotNull())
    dist = long.groupBy(*keys, "__name", "__v").agg(F.count(F.lit(1)).alias("__cnt"))
    pref = prefix_sums(dist, keys + ["__name"], ["__v"], ["__cnt"], unique=True)
    pref = pref.withColumnRenamed("__cnt_total", "__n")
    ranks = cut_lineage(pref.select(*keys, "__name", "__v",
                                    ((F.col("__cnt_before") + (F.col("__cnt") + 1) / 2.0) / F.col("__n")).alias("__r")))
    out = df
    for v, o in zip(values, outs):
        r = ranks.filter(F.col("__name") == v).select(
            *[F.col(k).alias(f"__rk_{k}") for k in keys], F.col("__v").alias("__val"), F.col("__r").alias(o))
        cond = F.col(v).cast("double") == F.col("__val")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__rk_{k}"))
        out = out.join(r, cond, "left").drop(*[f"__rk_{k}" for k in keys], "__val")
    return out


def ordinal_rank_pct(
    df: DataFrame,
    value: str,
    row_id: str,
    out: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Percent rank with ordinal ties, first ``row_id`` wins (D07):
    position by (value, row_id) / non-missing rows; a missing value keeps a
    missing rank and does not count.  Equal to pandas ``rank(method='first', pct=True)``.

    Ties are positioned by a second prefix keyed by the value, so one heavily
    tied value is split over many tasks; the group's total comes with the
    first one.
    """
    keys = list(keys)
    one = df.withColumn("__one", F.col(value).isNotNull().cast("int"))
    dist = one.groupBy(*keys, value).agg(F.sum("__one").alias("__one"))
    below = _unique_prefix(dist, keys, value, ["__one"]).select(
        *keys, value, F.col("__one_before").alias("__low"), F.col("__one_total").alias("__n"))
    tied = prefix_sums(join_back(one, below, keys + [value], how="left"), keys + [value], [row_id], ["__one"])
    rank = (F.col("__low") + F.col("__one_before") + 1) / F.col("__n")
    return tied.select(*df.columns, F.when(F.col(value).isNotNull(), rank).alias(out))


def _rows_at(df: DataFrame, order: list[str], places: list[int]) -> dict[int, tuple]:
    """The ``order`` tuple (two columns) standing at each 0-based place of the
    sorted rows; the first column has no missing value, missing ids stand last.

    Distinct first values and their places come from one prefix pass; only
    rows of the at most ``len(places)`` values found are ordered further.
    """
    x, rest = order
    at = F.explode(F.array(*[F.lit(p).cast("long") for p in places])).alias("__at")
    below, n = F.col("__n_before"), F.col("__n")

    def found(counts: DataFrame, keys: list[str], col: str) -> DataFrame:
        return prefix_sums(counts, keys, [col], ["__n"], unique=True).drop("__n_total")

    values = found(df.groupBy(x).agg(F.count(F.lit(1)).alias("__n")), [], x)
    hit = values.select(x, below.alias("__low"), n, at).filter((F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__low") + n))
    hit = [(r[x], r["__low"], r["__at"]) for r in hit.collect()]
    few = list({repr(v): v for v, _, _ in hit}.values())
    tied = df.filter(F.col(x).isin(few)).groupBy(x, rest).agg(F.count(F.lit(1)).alias("__n"))
    want = F.lit(False)
    for v, low, p in hit:
        want = want | ((F.col(x) == F.lit(v)) & (below <= p - low) & (below + n > p - low))
    ids = found(tied, [x], rest).filter(want).select(x, rest, below, n).collect()
    return {p: (v, next(r[rest] for r in ids if repr(r[x]) == repr(v) and r["__n_before"] <= p - low < r["__n_before"] + r["__n"])) for v, low, p in hit}


def equal_count_bins(df: DataFrame, value: str, row_id: str, out: str, bins: int = 16) -> DataFrame:
    """Equal-count bins by first-occurrence rank (D09), equal to ``qcut`` of
    the ordinal rank: ``greatest(((rn-1)*q + n-2) div (n-1) - 1, 0)`` with n
    the non-missing rows.  A missing value has no bin; callers that skip
    incomplete columns ask :func:`is_complete` first.

    A row's bin is the number of bin edges below it.  The ``bins - 1`` edge
    rows (value, id) are read once, so the frame gets one projection: no row
    is moved and no plan grows with the columns binned.
    """
    rows = cut_lineage(df.select(value, row_id).filter(F.col(value).isNotNull()))
    n = rows.count()
    # Bin j starts at the first place p with (p * bins + n - 2) div (n - 1) - 1 >= j; the row before it is its edge.
    starts = [-(-(j * (n - 1) + 1) // bins) for j in range(1, bins)] if n > 1 else []
    edges = _rows_at(rows, [value, row_id], sorted({p - 1 for p in starts if p <= n})) if starts else {}
    x, i = F.col(value), F.col(row_id)
    binv = F.lit(0).cast("long")
    for p in starts:
        if p - 1 in edges:
            v, r = edges[p - 1]
            # A missing id is the largest of all.
            later = F.lit(False) if r is None else (i.isNull() | (i > F.lit(r)))
            binv = binv + F.when((x > F.lit(v)) | ((x == F.lit(v)) & later), 1).otherwise(0)
    return df.select("*", F.when(x.isNotNull(), binv.cast("long")).alias(out))


def is_complete(df: DataFrame, c: str) -> bool:
    """No missing value in the column (one 1-row aggregate, model control)."""
    return not df.agg(F.max(F.col(c).isNull().cast("int"))).first()[0]


def dense_index(df: DataFrame, value: str, out: str) -> DataFrame:
    """``dense_rank() - 1`` over the distinct values of ``value`` (C26),
    joined back to every row."""
    dist = df.select(value).filter(F.col(value).isNotNull()).distinct().withColumn("__one", F.lit(1))
    pref = prefix_sums(dist, [], [value], ["__one"], unique=True)
    codes = pref.select(value, F.col("__one_before").cast("int").alias(out))
    return join_back(df, codes, [value], how="left")
