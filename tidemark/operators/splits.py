"""Time folds, holdouts and seeded hash splits.

Fold membership is a narrow operation: each row is matched against the small
fold specification held as literals and exploded into one row per (fold,
role) it belongs to.  No join, no shuffle; per-fold reports are then one
``groupBy(fold, role)``.  Only the last fold's end depends on the data (max
day + 1); it is a scalar subquery, not a driver round trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import prefix_sums


def _d(s: str) -> Column:
    return F.lit(s).cast("date")


def fold_spec(df: DataFrame, day: str, cutoffs: Sequence[str], window_days: int | None = None) -> list[dict]:
    """Rolling expanding-window folds (I01) or recent-window folds.

    Fold k trains on ``[start, cutoff_k)`` and validates on
    ``[cutoff_k, cutoff_{k+1})``; the last fold closes at max day + 1.
    ``window_days`` limits the train side to that many days before the cutoff.
    """
    max_next = F.date_add(df.select(F.max(day)).scalar(), 1)
    out = []
    for i, c in enumerate(cutoffs):
        end = _d(cutoffs[i + 1]) if i + 1 < len(cutoffs) else max_next
        start = F.date_sub(_d(c), window_days) if window_days else F.lit(None).cast("date")
        out.append({"fold": i + 1, "train_start": start, "cutoff": _d(c), "valid_end": end, "end_inclusive": False})
    return out


def holdout_spec(holdouts: Sequence[tuple[str, str]], end: str | None = None) -> list[dict]:
    """Late holdouts (I03): train before the cutoff, valid to an inclusive end
    (open when ``end`` is None).  Holdouts may overlap by design."""
    return [
        {"fold": name, "train_start": F.lit(None).cast("date"), "cutoff": _d(c),
         "valid_end": _d(end) if end else F.lit(None).cast("date"), "end_inclusive": True}
        for name, c in holdouts
    ]


def side_condition(day: str, s: dict, role: str) -> Column:
    """Whether a row is on the ``train`` or ``valid`` side of one fold of a spec."""
    d = F.col(day)
    if role == "train":
        before = d < s["cutoff"]
        return F.when(s["train_start"].isNull(), before).otherwise(before & (d >= s["train_start"]))
    if role != "valid":
        raise ValueError(f"unknown role {role}")
    hi = (d <= s["valid_end"]) if s["end_inclusive"] else (d < s["valid_end"])
    return (d >= s["cutoff"]) & F.coalesce(hi, F.lit(bool(s["end_inclusive"])))


def assign_folds(df: DataFrame, day: str, spec: list[dict], fold_col: str = "fold", role_col: str = "role") -> DataFrame:
    """Row -> (fold, role) membership (F10); a row may land in many folds.

    Roles are ``train`` (day < cutoff, and >= train_start when set) and
    ``valid`` (cutoff <= day < valid_end, or <= valid_end for holdouts).
    """
    entries = [
        F.when(side_condition(day, s, role), F.struct(F.lit(s["fold"]).alias("f"), F.lit(role).alias("r")))
        for s in spec for role in ("train", "valid")
    ]
    return (
        df.select("*", F.explode(F.array(*entries)).alias("__fr"))
        .filter(F.col("__fr").isNotNull())
        .select(*df.columns, F.col("__fr.f").alias(fold_col), F.col("__fr.r").alias(role_col))
    )


def fold_table(df: DataFrame, day: str, label: str, fold_col: str = "fold", role_col: str = "role") -> DataFrame:
    """Per (fold, role): rows, first and last day, positive rate."""
    return df.groupBy(fold_col, role_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(day).alias("day_min"),
        F.max(day).alias("day_max"),
        F.sum(label).cast("long").alias("n_pos"),
        (F.sum(label) / F.count(F.lit(1))).alias("pos_rate"),
    )


def drop_empty_folds(member: DataFrame, fold_col: str = "fold", role_col: str = "role") -> DataFrame:
    """Rolling folds with an empty side are dropped, fold numbers kept.

    The folds with both sides (as many as there are cutoffs) are one scalar
    subquery, so rows are filtered where they are."""
    sides = member.groupBy(fold_col).agg(F.min(role_col).alias("__a"), F.max(role_col).alias("__z"))
    full = sides.filter(F.col("__a") != F.col("__z")).agg(F.collect_set(fold_col)).scalar()
    return member.filter(F.array_contains(full, F.col(fold_col)))


def hash_order(cols: Sequence[str], seed: int) -> Column:
    """Seeded, engine-independent pseudo-random order key."""
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int, train_share: float = 0.7,
                     out: str = "is_train") -> DataFrame:
    """Stratified train/valid split (I04): within each class the first
    ``ceil(share * n_class)`` rows in hash order are train.

    The last train row of each class is found by counts per hash range, then
    among the ids of the one range that holds it; a row is train if it stands
    at or before it, so no row is moved.  A missing id is the largest, rows
    without a class are dropped.
    """
    # ceil(n * share) in decimal arithmetic: 0.7 * 10 is exactly 7, not 7.000...1.
    from decimal import Decimal

    rows = df.filter(F.col(label).isNotNull())
    keyed = rows.select(label, F.col(id_col).alias("__id"), hash_order([id_col], seed).alias("__h"))
    keyed = keyed.withColumn("__range", F.shiftright("__h", 48))
    # At most 65,536 rows per class, each the count of a hash range.
    in_class = Window.partitionBy(label)
    so_far = lambda *order: F.sum("__n").over(in_class.orderBy(*order)) - F.col("__n")
    ranges = keyed.groupBy(label, "__range").agg(F.count(F.lit(1)).alias("__n"))
    last = F.ceil(F.sum("__n").over(in_class).cast("decimal(20,0)") * F.lit(Decimal(str(train_share)))) - 1
    at = (F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__low") + F.col("__n"))
    held = ranges.select(label, "__range", "__n", so_far("__range").alias("__low"), last.cast("long").alias("__at")).filter(at)
    near = keyed.join(F.broadcast(held.select(label, "__range", (F.col("__at") - F.col("__low")).alias("__at"))), [label, "__range"])
    ids = near.groupBy(label, "__at", "__h", "__id").agg(F.count(F.lit(1)).alias("__n"))
    edge = ids.withColumn("__low", so_far("__h", F.col("__id").asc_nulls_last())).filter(at)
    # One entry per class, as a map in a scalar subquery: rows stay where they are.
    edges = edge.agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), F.struct("__h", "__id"))))).scalar()
    e, h, i = F.element_at(edges, F.col(label)), hash_order([id_col], seed), F.col(id_col)
    first = (h < e["__h"]) | ((h == e["__h"]) & (e["__id"].isNull() | F.coalesce(i <= e["__id"], F.lit(False))))
    return rows.select(*df.columns, F.coalesce(first, F.lit(False)).cast("int").alias(out))


def stratified_kfold(df: DataFrame, label: str, order_cols: Sequence[str], k: int, out: str = "inner_fold",
                     unique: bool = True) -> DataFrame:
    """Stratified inner folds (I05): ``(position within class) % k`` where the
    position follows ``order_cols`` (a hash key and the id, or the id alone).
    ``unique`` promises that a single order column identifies a row; without
    it rows that tie share a position."""
    h = df.withColumn("__one", F.lit(1))
    pref = prefix_sums(h, [label], list(order_cols), ["__one"], unique=unique and len(order_cols) == 1)
    return pref.select(*df.columns, (F.col("__one_before") % k).cast("int").alias(out))


def effective_k(df: DataFrame, label: str, k: int) -> int:
    """k = max(2, min(k, rarest class count)) - one 2-row aggregate."""
    rare = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return max(2, min(k, int(rare or 0)))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement (I07): the ``n`` smallest hash
    keys (TakeOrderedAndProject keeps only ``n`` rows per task)."""
    return df.orderBy(hash_order([id_col], seed), F.col(id_col)).limit(n)
