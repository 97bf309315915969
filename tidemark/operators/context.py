"""Within-context offer features and context reports.

A context is the set of rows sharing the values of ``keys`` (missing equals
missing).  Two physical strategies give the same columns:

* ``window``    - one ``Window.partitionBy(keys)`` shared by every statistic:
                  one shuffle, one sort.  Right when contexts are small.
* ``aggregate`` - for contexts over ``hot_rows`` rows, ``groupBy(keys)``
                  statistics (partial aggregation on the map side) joined back
                  null-safely, and ranks of all offer columns from one bucketed
                  prefix-sum pass.  A context holding a third of all rows is
                  then spread over many tasks (AQE splits the skewed join
                  partition).  It moves each row about ten times, so contexts
                  that fit a task take ``window``, which moves it once;
                  ``hot_rows=0`` aggregates all.

``split`` is the same and can go on from rows dealt before (``dealt``).  One
aggregate counts the contexts; those of up to ``hot_rows`` rows stand in tasks
whose number follows the rows, so that the sorts of a task don't grow with the
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .ranks import average_rank_pct_multi, deal, join_back


#: Rows a window task may hold for one context.
HOT_CONTEXT_ROWS = 100_000


def hot_contexts(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Key tuples of contexts with more than ``rows`` rows (partial aggregation)."""
    return df.groupBy(*keys).count().filter(F.col("count") > rows).select(*keys)


def context_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows, and those of the largest context (one row on the driver)."""
    r = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return r[0] or 0, r[1] or 0


def _names(col: str, tag: str, flags: bool) -> dict[str, str]:
    n = {
        "spread": f"{col}_{tag}_spread",
        "minus_min": f"{col}_minus_{tag}_min",
        "minus_mean": f"{col}_minus_{tag}_mean",
        "rank": f"{col}_rank_pct_in_{tag}",
    }
    if flags:
        n["is_min"] = f"{col}_is_{tag}_min"
        n["is_max"] = f"{col}_is_{tag}_max"
    return n


def _derive(x: Column, mn: Column, mx: Column, mean: Column, names: dict[str, str]) -> list[Column]:
    out = [
        finite(mx - mn).alias(names["spread"]),
        finite(x - mn).alias(names["minus_min"]),
        finite(x - mean).alias(names["minus_mean"]),
    ]
    if "is_min" in names:
        out.append(F.coalesce((x == mn).cast("int"), F.lit(0)).alias(names["is_min"]))
        out.append(F.coalesce((x == mx).cast("int"), F.lit(0)).alias(names["is_max"]))
    return out


def context_features(
    df: DataFrame,
    keys: Sequence[str],
    offer_cols: Sequence[str],
    tag: str = "context",
    flags: bool = False,
    strategy: str = "split",
    hot_rows: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """``<tag>_offer_count`` plus, per offer column, spread, value
    minus min, value minus mean, average-tie percent rank (missing stays
    missing, divided by the non-missing count) and optional is-min / is-max
    flags (missing -> 0).  Use ``keys + [day]`` for the same-day variant.  ``dealt``
    says that rows of a context share a task already (a call with some of the
    keys came before, without hot contexts)."""
    keys = list(keys)
    count_name = f"{tag}_offer_count"
    if strategy in ("split", "aggregate"):
        limit = HOT_CONTEXT_ROWS if hot_rows is None else hot_rows
        rows, largest = (0, 0) if dealt else context_sizes(df, keys)
        if largest <= limit:
            return context_features(df if dealt else deal(df, rows, *keys), keys, offer_cols, tag, flags, "window")
        hot = hot_contexts(df, keys, limit)
        calm = deal(join_back(df, hot, keys, how="left_anti"), rows, *keys)
        small = context_features(calm, keys, offer_cols, tag, flags, "window")
        large = _aggregated(join_back(df, hot, keys, how="left_semi"), keys, offer_cols, tag, flags)
        return small.unionByName(large)

    if strategy == "window":
        w = Window.partitionBy(*keys)
        cols = [F.count(F.lit(1)).over(w).cast("int").alias(count_name)]
        for c in offer_cols:
            x = F.col(c)
            names = _names(c, tag, flags)
            mn, mx, mean = F.min(x).over(w), F.max(x).over(w), F.avg(x).over(w)
            wr = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
            # Peers of x (RANGE 0..0) on the same partitioning: no extra exchange.
            ties = F.count(x).over(wr.rangeBetween(0, 0))
            rank = F.when(x.isNotNull(), (F.rank().over(wr) + (ties - 1) / 2.0) / F.count(x).over(w))
            cols += _derive(x, mn, mx, mean, names) + [rank.alias(names["rank"])]
        return df.select("*", *cols)

    raise ValueError(f"unknown strategy {strategy}")


def _aggregated(df: DataFrame, keys: list[str], offer_cols: Sequence[str], tag: str, flags: bool) -> DataFrame:
    """Context features with no context in one task."""
    count_name = f"{tag}_offer_count"
    aggs = [F.count(F.lit(1)).cast("int").alias(count_name)]
    for c in offer_cols:
        aggs += [F.min(c).alias(f"__min_{c}"), F.max(c).alias(f"__max_{c}"), F.avg(c).alias(f"__avg_{c}")]
    stats = df.groupBy(*keys).agg(*aggs)
    out = join_back(df, stats, keys, how="left")
    # All offer columns ranked in one prefix pass.
    out = average_rank_pct_multi(out, list(offer_cols), [_names(c, tag, flags)["rank"] for c in offer_cols], keys)
    cols = [F.col(count_name)]
    for c in offer_cols:
        names = _names(c, tag, flags)
        cols += _derive(F.col(c), F.col(f"__min_{c}"), F.col(f"__max_{c}"), F.col(f"__avg_{c}"), names)
        cols.append(F.col(names["rank"]))
    return out.select(*df.columns, *cols)


def context_size_histogram(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per context size: contexts, rows, positive rate of those rows."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum(label).alias("__pos"))
    return g.groupBy("size").agg(
        F.count(F.lit(1)).alias("n_contexts"),
        F.sum("size").alias("n_rows"),
        (F.sum("__pos") / F.sum("size")).alias("pos_rate"),
    )


def context_report(df: DataFrame, keys: Sequence[str], offer_cols: Sequence[str], label: str) -> DataFrame:
    """Contexts, repeated contexts and their rows, max size, contexts with
    varying offer terms, conflicting-target contexts and their rows."""
    vary = F.lit(False)
    aggs = [F.count(F.lit(1)).alias("size"), F.countDistinct(label).alias("__k")]
    for c in offer_cols:
        aggs.append(F.countDistinct(c).alias(f"__d_{c}"))
        vary = vary | (F.col(f"__d_{c}") > 1)
    g = df.groupBy(*keys).agg(*aggs)
    rep = F.col("size") > 1
    conf = rep & (F.col("__k") > 1)
    return g.agg(
        F.count(F.lit(1)).alias("n_contexts"),
        F.count_if(rep).alias("n_repeated"),
        F.coalesce(F.sum(F.when(rep, F.col("size"))), F.lit(0)).alias("rows_in_repeated"),
        F.max("size").alias("max_size"),
        F.count_if(vary).alias("n_varying_terms"),
        F.count_if(conf).alias("n_conflicting"),
        F.coalesce(F.sum(F.when(conf, F.col("size"))), F.lit(0)).alias("rows_in_conflicting"),
    )


def offer_prevalence(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows and prevalence of contexts with one offer and with several."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum(label).alias("__pos"))
    return g.groupBy((F.col("size") > 1).alias("multi_offer")).agg(
        F.sum("size").alias("n_rows"), (F.sum("__pos") / F.sum("size")).alias("pos_rate"))


def context_overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contexts present on both sides and the rows in them (one grouping of the tagged union)."""
    both = train.select(*keys, F.lit(0).alias("__side")).unionByName(test.select(*keys, F.lit(1).alias("__side")))
    g = both.groupBy(*keys).agg(F.count_if(F.col("__side") == 0).alias("t"), F.count_if(F.col("__side") == 1).alias("e"))
    shared = (F.col("t") > 0) & (F.col("e") > 0)
    total = lambda c: F.coalesce(F.sum(F.when(shared, F.col(c))), F.lit(0))
    return g.agg(F.count_if(shared).alias("shared_contexts"), total("t").alias("train_rows_shared"), total("e").alias("test_rows_shared"))


def repeated_by_month(df: DataFrame, keys: Sequence[str], day: str, label: str) -> DataFrame:
    """E11 + E12: per month, repeated contexts (groups, rows, max size) and
    conflicting-target contexts (groups, rows, positives)."""
    m = F.date_format(F.col(day), "yyyy-MM").alias("month")
    g = df.groupBy(m, *keys).agg(F.count(F.lit(1)).alias("size"), F.countDistinct(label).alias("__k"),
                                 F.sum(label).alias("__pos"))
    rep = F.col("size") > 1
    conf = rep & (F.col("__k") > 1)
    return g.groupBy("month").agg(
        F.count_if(rep).alias("repeated_groups"),
        F.coalesce(F.sum(F.when(rep, F.col("size"))), F.lit(0)).alias("repeated_rows"),
        F.max("size").alias("max_size"),
        F.count_if(conf).alias("conflict_groups"),
        F.coalesce(F.sum(F.when(conf, F.col("size"))), F.lit(0)).alias("conflict_rows"),
        F.coalesce(F.sum(F.when(conf, F.col("__pos"))), F.lit(0)).cast("long").alias("conflict_pos"),
    )


def fold_context_overlap(member: DataFrame, keys: Sequence[str], day: str, fold_col: str = "fold",
                         role_col: str = "role") -> DataFrame:
    """Per fold, train/valid rows and day spans, contexts present on both
    sides and the rows in them on each side (fold membership from F10)."""
    is_tr = F.col(role_col) == "train"
    sides = member.groupBy(fold_col).agg(
        F.count_if(is_tr).alias("train_rows"), F.count_if(~is_tr).alias("valid_rows"),
        F.min(F.when(is_tr, F.col(day))).alias("train_start"), F.max(F.when(is_tr, F.col(day))).alias("train_end"),
        F.min(F.when(~is_tr, F.col(day))).alias("valid_start"), F.max(F.when(~is_tr, F.col(day))).alias("valid_end"),
    )
    g = member.groupBy(fold_col, *keys).agg(F.count_if(is_tr).alias("__t"), F.count_if(~is_tr).alias("__v"))
    shared = g.filter((F.col("__t") > 0) & (F.col("__v") > 0)).groupBy(fold_col).agg(
        F.count(F.lit(1)).alias("shared_contexts"), F.sum("__t").alias("train_rows_shared"),
        F.sum("__v").alias("valid_rows_shared"))
    out = sides.join(shared, fold_col, "left")
    return out.select(
        *sides.columns,
        F.coalesce("shared_contexts", F.lit(0).cast("long")).alias("shared_contexts"),
        F.coalesce("train_rows_shared", F.lit(0).cast("long")).alias("train_rows_shared"),
        F.coalesce("valid_rows_shared", F.lit(0).cast("long")).alias("valid_rows_shared"),
    )
