"""Rank normalisation, blends, weight scans, gates and verdicts
(D06-D08, D10, D11, F01, F02, F11, F12, L01-L10).

Prediction sets live in one long table keyed by (scope, group, row); model
scores are columns after a key join (never positional stacking).  Ranks are
computed once per group, then a weight grid is attached to every row by
exploding a literal array (no join), and the AUC of every (weight, group)
comes out of one grouped :func:`metrics.auc_table` job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import DEC, auc_table
from .ranks import BUCKET, BUCKETS, average_rank_pct, average_rank_pct_multi, join_back, ordinal_rank_pct

# Gate tolerances against the champion and the verdict rule.
FOLD3_TOLERANCE = -0.0002
LATE_MEAN_TOLERANCE = -0.001
LATE_MIN_TOLERANCE = -0.002
VERDICT_MIN_DELTA = -0.001
REFERENCE_TOLERANCE = 1e-6

#: Score tuples blended together, and values of a point that one task orders (about).
BLOCK_TUPLES, SLOT_VALUES = 50_000, 200_000


def rank_normalize(df: DataFrame, col: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """D06 (global) / D08 (inside ``keys``): average-tie rank / n."""
    return average_rank_pct(df, col, out, keys)


def rank_ordinal(df: DataFrame, col: str, row_id: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ordinal-tie rank / n (first row id wins)."""
    return ordinal_rank_pct(df, col, row_id, out, keys)


def weighted_sum(weights: dict[str, float]) -> Column:
    """``sum(w_i * score_i)`` in the given order."""
    expr = None
    for c, w in weights.items():
        term = F.lit(float(w)) * F.col(c)
        expr = term if expr is None else expr + term
    return expr


def rank_blend(df: DataFrame, a: str, b: str, w: float, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(1 - w) * rank(a) + w * rank(b)`` with ranks inside ``keys``."""
    r = average_rank_pct_multi(df, [a, b], ["__ra", "__rb"], keys)
    return r.withColumn(out, F.lit(round(1.0 - w, 10)) * F.col("__ra") + F.lit(w) * F.col("__rb")).drop("__ra", "__rb")


def segment_rank_mix(df: DataFrame, score: str, segment: str, lam: float, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(1 - lambda) * global rank + lambda * rank inside the segment``."""
    r = rank_normalize(df, score, "__g", keys)
    r = rank_normalize(r, score, "__s", [*keys, segment])
    return r.withColumn(out, F.lit(round(1.0 - lam, 10)) * F.col("__g") + F.lit(lam) * F.col("__s")).drop("__g", "__s")


def position_signal(df: DataFrame, rank_col: str, signal: str, alpha: float, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank plus ``alpha`` times the percent rank of a position / day signal."""
    r = rank_normalize(df, signal, "__p", keys)
    return r.withColumn(out, F.col(rank_col) + F.lit(alpha) * F.col("__p")).drop("__p")


def join_predictions(left: DataFrame, right: DataFrame, keys: Sequence[str], one_to_one: bool = True) -> DataFrame:
    """Inner key join of two prediction sets; with
    ``one_to_one`` each side must have unique keys (one aggregate per side)."""
    if one_to_one:
        for name, side in (("left", left), ("right", right)):
            dup = side.groupBy(*keys).count().filter(F.col("count") > 1).select(F.count(F.lit(1))).first()[0]
            if dup:
                raise ValueError(f"{name} side has {dup} duplicated keys {list(keys)}")
    return left.join(right, list(keys), "inner")


def weight_grid_1d(step: float, max_w: float) -> list[float]:
    """Candidate weights 0, step, ..., max_w (rounded like the report)."""
    n = int(round(max_w / step))
    return [round(i * step, 4) for i in range(n + 1)]


def simplex_grid(parts: int = 20) -> list[tuple[int, int, int]]:
    """Integer weights (i, j, k) with i + j + k = parts (231 points for 20)."""
    return [(i, j, parts - i - j) for i in range(parts + 1) for j in range(parts + 1 - i)]


def _score_counts(df: DataFrame, cols: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Rows per (group, label, score tuple), stored once: a scan explodes the
    weights over these instead of over the rows and their rank plans.  They
    are spread over all shuffle partitions, as the explode makes many of each."""
    counts = cut_lineage(df.groupBy(*keys, label, *cols).agg(F.count(F.lit(1)).alias("__n")))
    return counts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def scan_1d(df: DataFrame, a: str, b: str, label: str, keys: Sequence[str], weights: Sequence[float],
            pooled: bool = True) -> DataFrame:
    """AUC of ``(1 - w) * a + w * b`` for every weight and group in
    one job.  The weight list is a literal array exploded per score tuple (a
    bounded Generate, not a join), and so is the pooled group; output
    (w, group..., roc_auc)."""
    grid = F.array(*[F.lit(float(w)) for w in weights])
    names = [F.col(k).cast("string").alias(k) for k in keys]
    scopes = [F.struct(*names)] + ([F.struct(*[F.lit("OOF").alias(k) for k in keys])] if pooled and keys else []) if keys else []
    x = _score_counts(df, [a, b], label, keys).select(*keys, label, a, b, "__n", F.explode(grid).alias("w"))
    x = x.withColumn("__blend", (F.lit(1.0) - F.col("w")) * F.col(a) + F.col("w") * F.col(b)).select(
        "w", label, "__blend", "__n", *([F.explode(F.array(*scopes)).alias("__scope")] if scopes else []))
    if scopes:
        x = x.select("w", label, "__blend", "__n", "__scope.*")
    return auc_table(x, label, "__blend", ["w", *keys], count="__n").select("w", *keys, "roc_auc")


def scan_simplex(df: DataFrame, cols: Sequence[str], label: str, keys: Sequence[str], parts: int = 20) -> DataFrame:
    """AUC on every point of the 3-way simplex (weights in 1/parts) in one
    job; output (i, j, k, group..., roc_auc) with integer weights.

    A point's blends travel as packed numbers, 8 bytes or less each, and only
    once: every block of score tuples is blended, sorted and cut at the same
    slot edges, so the values of a slot meet in one task, whose numbers follow
    the tuples (edges come from the ``BUCKETS - 1`` tuples first in hash order,
    read once).  Sums across slots are exact, as in :func:`metrics.auc_table`."""
    keys = list(keys)
    a, b, c = cols
    given = df.filter(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull())
    counts = cut_lineage(given.groupBy(*keys, F.col(label).cast("long").alias("__y"), *[F.col(x).cast("double").alias(x) for x in cols]).agg(
        F.count(F.lit(1)).alias("__n")))
    n = counts.count()
    few = counts.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(BUCKETS - 1).toArrow()
    few = [few.column(x).to_numpy() for x in cols]
    slots, d = max(1, min(-(-n // SLOT_VALUES), len(few[0]))), float(parts)
    points = simplex_grid(parts)

    def blended(x: Sequence[np.ndarray], point: tuple[int, int, int]) -> np.ndarray:
        i, j, k = point
        return (i / d) * x[0] + (j / d) * x[1] + (k / d) * x[2] + 0.0

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        x, times = [rows.column(v).to_numpy() for v in cols], rows.column("__n").to_numpy()
        for point in points:
            v = blended(x, point)
            order = np.argsort(v)
            v, t = v[order], times[order]
            edges = np.sort(blended(few, point))[len(few[0]) * np.arange(1, slots) // slots]
            cuts = [0, *np.searchsorted(v, edges, "left"), len(v)]
            got = [(s, *_packed(v[lo:hi], t[lo:hi])) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            same = [pa.repeat(k, len(got)) for k in key[: len(keys) + 1]] + [pa.repeat(pa.scalar(p, pa.int32()), len(got)) for p in point]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(z, t) for z, t in zip(zip(*got), (pa.int32(), pa.binary(), pa.binary())))], names=packed_names)

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = [_unpacked(*(rows.column(c)[r].as_py() for c in ("__v", "__t"))) for r in range(rows.num_rows)]
        v = np.concatenate([p[0] for p in parts])
        t = np.concatenate([p[1] for p in parts])
        y = np.repeat(rows.column("__y").to_numpy(), [len(p[0]) for p in parts])
        order = np.argsort(v)
        v, pos, neg = v[order], (y * t)[order], ((1 - y) * t)[order]
        # Equal values (and NaN, the largest of all) stand together.
        at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) & ~np.isnan(v[:-1])]))
        p, q = np.add.reduceat(pos, at), np.add.reduceat(neg, at)
        beaten = 2 * (np.cumsum(q) - q) + q
        # Two halves of 31 bits, so that no sum passes 64 bits.
        num = (int((p * (beaten >> 31)).sum()) << 31) + int((p * (beaten & (2**31 - 1))).sum())
        out = [pa.repeat(k, 1) for k in key] + [pa.array([Decimal(num)], pa.decimal128(38, 0)), *(pa.array([int(x.sum())]) for x in (p, q))]
        return pa.Table.from_arrays(out, names=merged_names)

    types = dict(counts.dtypes)
    group = [*keys, "i", "j", "k"]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "`__y` long", "i int", "j int", "k int", f"`{BUCKET}` int"])
    packed_names = [*keys, "__y", "i", "j", "k", BUCKET, "__v", "__t"]
    merged_names = [*group, BUCKET, "__num", "__pos", "__neg"]
    blocks = max(1, -(-n // BLOCK_TUPLES))
    dealt = counts.withColumn("__block", F.pmod(F.xxhash64(*cols), F.lit(blocks))).repartition(
        max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks), "__block")
    packed = dealt.groupBy(*keys, "__y", "__block").applyInArrow(pack, f"{schema}, `__v` binary, `__t` binary")
    merged = packed.groupBy(*group, BUCKET).applyInArrow(merge, schema.replace("`__y` long, ", "") + ", `__num` decimal(38,0), `__pos` long, `__neg` long")
    across = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: F.col(c).cast(DEC)
    below = merged.withColumn("__below", F.coalesce(F.sum("__neg").over(across), F.lit(0)))
    sums = below.groupBy(*group).agg(F.sum(F.col("__num") + 2 * exact("__pos") * exact("__below")).alias("__num"),
                                     F.sum("__pos").cast("double").alias("__p"), F.sum("__neg").cast("double").alias("__q"))
    auc = F.when((F.col("__p") > 0) & (F.col("__q") > 0), F.col("__num").cast("double") / (2 * F.col("__p") * F.col("__q")))
    return sums.select("i", "j", "k", *keys, auc.alias("roc_auc"))


def _packed(v: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes | None]:
    """Sorted doubles with equal bytes side by side, which compress; their multiplicities, None if all are 1."""
    return v.view(np.uint8).reshape(-1, 8).T.tobytes(), None if (times == 1).all() else times.astype(np.int64).tobytes()


def _unpacked(v: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_packed` was given."""
    values = np.ascontiguousarray(np.frombuffer(v, np.uint8).reshape(8, -1).T).view(np.float64).ravel()
    return values, np.ones(len(values), np.int64) if times is None else np.frombuffer(times, np.int64)


def gate(df: DataFrame, champ_fold3, champ_lh_mean, champ_lh_min, reference_lh_min=None) -> DataFrame:
    """Gate columns; a missing late-holdout metric passes.  The
    champion's values are numbers or columns (scalar subqueries).  With
    ``reference_lh_min`` the smallest late-holdout AUC must also reach that
    reference (up to 1e-6)."""
    value = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    f3 = F.col("fold3_auc") >= value(champ_fold3) + F.lit(FOLD3_TOLERANCE)
    lm = F.col("lh_mean").isNull() | (F.col("lh_mean") >= value(champ_lh_mean) + F.lit(LATE_MEAN_TOLERANCE))
    ln = F.col("lh_min").isNull() | (F.col("lh_min") >= value(champ_lh_min) + F.lit(LATE_MIN_TOLERANCE))
    passed = f3 & lm & ln
    out = df.withColumn("fold3_gate", f3).withColumn("lh_gate", lm & ln)
    if reference_lh_min is not None:
        reached = F.coalesce(F.col("lh_min") >= value(reference_lh_min) - F.lit(REFERENCE_TOLERANCE), F.lit(True))
        out, passed = out.withColumn("reference_gate", reached), passed & reached
    return out.withColumn("pass_all_gates", passed)


def selection_score(lh_mean: str = "lh_mean", fold3: str = "fold3_auc", weight: float = 0.25) -> Column:
    """``lh_mean + 0.25 * fold3``."""
    return F.col(lh_mean) + F.lit(weight) * F.col(fold3)


def verdict(delta_mean: Column, delta_min: Column, current: Column | None = None) -> Column:
    """PASS_WITH_RISKS when delta_min >= -0.001 and delta_mean >= 0, else
    RETEST; with ``current`` an existing verdict is only upgraded from RETEST."""
    v = F.when((delta_min >= F.lit(VERDICT_MIN_DELTA)) & (delta_mean >= 0), F.lit("PASS_WITH_RISKS")).otherwise(F.lit("RETEST"))
    if current is None:
        return v
    return F.when((v == "PASS_WITH_RISKS") & (current == "RETEST"), v).otherwise(current)


def seed_average_rank(long: DataFrame, score: str, row_id: str, seed: str, keys: Sequence[str], out: str) -> DataFrame:
    """Rank inside (seed, keys), then average over seeds per row."""
    r = rank_normalize(long, score, "__r", [seed, *keys])
    return r.groupBy(*keys, row_id).agg(F.avg("__r").alias(out))


def compare_to_champion(aucs: DataFrame, model: str, key: str, champion: str, metric: str = "roc_auc") -> DataFrame:
    """Per key, every model's metric next to the champion's and the delta."""
    ch = aucs.filter(F.col(model) == champion).select(key, F.col(metric).alias("champion_auc"))
    return aucs.join(ch, key).withColumn("delta", F.col(metric) - F.col("champion_auc"))


def align_to_ids(ids: DataFrame, scores: DataFrame, id_col: str, pos: str) -> DataFrame:
    """scores in the order of the reference id table (carrying ``pos``);
    raises when any id has no score."""
    out = join_back(ids.select(id_col, pos), scores, [id_col], how="left")
    value_cols = [c for c in scores.columns if c != id_col]
    any_missing = F.lit(False)
    for c in value_cols:
        any_missing = any_missing | F.col(c).isNull()
    miss = out.agg(F.count_if(any_missing)).first()[0]
    if miss:
        raise ValueError(f"{miss} ids have no score")
    return out
