"""Pairwise ranking inside groups without making pairs.

The objective is the squared hinge over all (positive, negative) pairs of a
group, ``max(0, 1 - (s_pos - s_neg)) ** 2``.  A positive at s meets exactly
the negatives above s - 1.  With positives placed at s - 1 and negatives at
s on one line per group, the counts and sums of the other class beyond a row
are prefix sums, so loss and gradient of all pairs cost one ordering of the
rows: linear in rows whatever the number of pairs, and a group that holds a
third of all rows is spread over the buckets of :func:`ranks.prefix_sums`.

Rows with a missing score, label or group take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import packed
from .ranks import deal, join_back, prefix_sums


#: Rows above which a group's line is split over many tasks.
HOT_ROWS = 100_000

_SUMS = ["__n", "__ns", "__nss", "__p", "__ps"]


def hot_groups(df: DataFrame, groups: Sequence[str], above: int = HOT_ROWS) -> DataFrame | None:
    """The groups with more than ``above`` rows (at most rows / ``above`` of them), or None."""
    big = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > above).select(*groups).collect()
    return df.sparkSession.createDataFrame(big, df.select(*groups).schema) if big else None


def pair_slopes(df: DataFrame, groups: Sequence[str], label: str, score: str, hot: DataFrame | None = None) -> DataFrame:
    """``df`` plus, per row, ``pair_slope`` (derivative of the summed loss by
    its score), ``pair_loss`` (of a positive with all its negatives, 0 for a
    negative) and ``pairs`` (likewise, their number).

    ``hot`` names the groups that one task should not hold; the others take a
    window each, in one shuffle, with the same results."""
    groups = list(groups)
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    usable = s.isNotNull() & ~F.isnan(s) & y.isin(0, 1)
    for g in groups:
        usable = usable & F.col(g).isNotNull()
    neg, pos = (1 - y).cast("double"), y.cast("double")
    values = [neg, neg * s, neg * s * s, pos, pos * s]
    rows = df.filter(usable).select(*df.columns, (s - y).alias("__at"), *[v.alias(c) for c, v in zip(_SUMS, values)])
    if hot is None:
        return _slopes(_one_task_lines(rows, groups), df.columns, s, y)
    few = F.broadcast(hot)
    calm, busy = rows.join(few, groups, "left_anti"), rows.join(few, groups, "left_semi")
    return _slopes(_one_task_lines(calm, groups), df.columns, s, y).unionByName(_slopes(_split_lines(busy, groups), df.columns, s, y))


def _one_task_lines(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``<c>_in``: the sum up to a row's place, ties included, and ``<c>_total``: that of the group."""
    whole = Window.partitionBy(*groups)
    so_far = whole.orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", *[F.sum(c).over(so_far).alias(f"{c}_in") for c in _SUMS], *[F.sum(c).over(whole).alias(f"{c}_total") for c in _SUMS])


def _split_lines(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The same sums from value buckets, no group in one task."""
    line = rows.groupBy(*groups, "__at").agg(*[F.sum(c).alias(c) for c in _SUMS])
    line = prefix_sums(line, groups, ["__at"], _SUMS, unique=True)
    line = line.select(*groups, "__at", *[(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_in") for c in _SUMS], *[f"{c}_total" for c in _SUMS])
    return join_back(rows, line, [*groups, "__at"], how="inner")


def _slopes(line: DataFrame, columns: list[str], s: Column, y: Column) -> DataFrame:
    """Slopes from the sums along the line.  A pair at the very margin adds nothing, so ties may stand on either side."""
    n, ns, nss = (F.col(f"{c}_total") - F.col(f"{c}_in") for c in _SUMS[:3])
    margin = 1.0 - s
    up = -2.0 * (n * margin + ns)
    down = 2.0 * (F.col("__p_in") * (1.0 + s) - F.col("__ps_in"))
    loss = n * margin * margin + 2.0 * margin * ns + nss
    return line.select(*columns, F.when(y == 1, up).otherwise(down).alias("pair_slope"), F.when(y == 1, loss).otherwise(0.0).alias("pair_loss"),
                       F.when(y == 1, F.col("__n_total")).otherwise(0.0).alias("pairs"))


def linear_score(x: Column, weights: Sequence[float]) -> Column:
    """Sum of feature times weight over an array column, written out so that it is compiled."""
    return sum((F.get(x, F.lit(i)) * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def by_model(model: Column, x: Column, weights: dict) -> Column:
    """The score under the weights that ``model`` names; null for any other name."""
    out = F.lit(None).cast("double")
    for name, w in weights.items():
        out = F.when(model == F.lit(name), linear_score(x, w)).otherwise(out)
    return out


def group_sums(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Loss, pairs and derivative by the weights of one group's pairs, as :func:`pair_slopes` has them row by row."""
    held = ~np.isnan(s)
    x, y, s = x[held], y[held].astype(float), s[held]
    at = s - y
    order = np.argsort(at)
    line = at[order]
    values = np.stack([1 - y, (1 - y) * s, (1 - y) * s * s, y, y * s])
    sums = np.concatenate([np.zeros((5, 1)), np.cumsum(values[:, order], axis=1)], axis=1)
    upto = sums[:, np.searchsorted(line, at, "right")]
    n, ns, nss = sums[:3, -1:] - upto[:3]
    margin = 1 - s
    slope = np.where(y == 1, -2 * (n * margin + ns), 2 * (upto[3] * (1 + s) - upto[4]))
    loss = np.where(y == 1, n * margin * margin + 2 * margin * ns + nss, 0.0)
    return np.concatenate([[loss.sum(), y.sum() * sums[0, -1]], slope @ x])


def _group_blocks(rows: DataFrame, model: str, group: str, x: str, label: str, n_features: int) -> DataFrame:
    """A packed block per (model, group), dealt to tasks by their rows and stored."""
    y = F.col(label).cast("int")
    whole = (F.size(x) >= n_features) & F.forall(F.slice(x, 1, n_features), lambda v: v.isNotNull() & ~F.isnan(v))
    data = rows.filter(y.isin(0, 1) & F.col(model).isNotNull() & F.col(group).isNotNull() & whole).select(
        model, group, F.slice(x, 1, n_features).cast("array<double>").alias("__x"), y.cast("tinyint").alias("__y"))
    names = [model, "mask", "wide", "narrow", "y"]

    def block(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        cells = packed.pack(packed.matrix(part.column("__x").combine_chunks(), n_features))
        y = part.column("__y").to_numpy().tobytes()
        return pa.Table.from_arrays([pa.repeat(key[0], 1), *(pa.array([c], pa.binary()) for c in (*cells, y))], names=names)

    schema = f"`{model}` {dict(rows.dtypes)[model]}, mask binary, wide binary, narrow binary, y binary"
    return cut_lineage(deal(data, data.count(), model, group).groupBy(model, group).applyInArrow(block, schema))


def _group_pass(blocks: DataFrame, model: str, w: dict, n_features: int) -> dict:
    """Per model: the sums of :func:`group_sums` over its groups, one row of them from each task."""
    names = list(w)
    given = {m: np.array(v) for m, v in w.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(2 + n_features) for m in names}
        for m, mask, wide, narrow, y in packed.rows(batches):
            y = np.frombuffer(y, np.int8)
            x = packed.unpack(mask, wide, narrow, len(y))
            with np.errstate(invalid="ignore"):
                sums[m] += group_sums(x, y, x @ given[m])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([sums[m].tolist() for m in names], pa.list_(pa.float64()))],
                                         names=["model", "sums"])

    parts = blocks.mapInArrow(run, "model int, sums array<double>").select("model", F.posexplode("sums"))
    out = {m: np.zeros(2 + n_features) for m in names}
    for r in parts.groupBy("model", "pos").agg(F.sum("col").alias("v")).collect():
        out[names[r["model"]]][r["pos"]] = r["v"]
    return out


def fit_pairwise(rows: DataFrame, model: str, group: str, x: str, label: str, n_features: int, iterations: int = 10,
                 l2: float = 1e-3) -> tuple[dict, dict[object, list[float]]]:
    """Weights of one linear ranker per value of ``model`` (few: folds or
    windows), all fitted side by side.  A group that fits a task is moved once
    and stored as one packed block: an iteration is one pass over the blocks,
    which moves nothing but sums.  Larger groups are ordered by
    :func:`pair_slopes` in every iteration.

    Gradient steps from zero with Barzilai-Borwein lengths; the weights with
    the smallest objective seen are kept.  Returns (weights, objectives).
    """
    rows = rows.select(model, group, x, label)
    names = [r[0] for r in rows.select(model).distinct().collect()]
    hot = hot_groups(rows, [model, group])
    calm = rows if hot is None else rows.join(F.broadcast(hot), [model, group], "left_anti")
    busy = None if hot is None else cut_lineage(rows.join(F.broadcast(hot), [model, group], "left_semi"))
    blocks = _group_blocks(calm, model, group, x, label, n_features)
    w = {m: [0.0] * n_features for m in names}
    best, history, last = dict(w), {m: [] for m in names}, {}
    for _ in range(iterations):
        sums = _group_pass(blocks, model, w, n_features)
        if busy is not None:
            slopes = pair_slopes(busy.withColumn("__s", by_model(F.col(model), F.col(x), w)), [model, group], label, "__s", hot)
            for r in slopes.groupBy(model).agg(F.sum("pair_loss"), F.sum("pairs"), *[F.sum(F.col("pair_slope") * F.get(x, F.lit(i))) for i in range(n_features)]).collect():
                sums[r[0]] += np.array([v or 0.0 for v in r[1:]])
        for m, (loss, pairs, *slope) in sums.items():
            if not pairs:
                continue
            now = w[m]
            history[m].append(float(loss / pairs) + l2 * sum(v * v for v in now))
            g = [float(s / pairs) + 2 * l2 * v for s, v in zip(slope, now)]
            if history[m][-1] <= min(history[m]):
                best[m] = now
            step = 0.25 / n_features
            if m in last:
                dw, dg = ([a - b for a, b in zip(new, old)] for new, old in zip((now, g), last[m]))
                bend = sum(a * b for a, b in zip(dw, dg))
                step = min(sum(a * a for a in dw) / bend, 10.0) if bend > 0 else step
            last[m] = (now, g)
            w[m] = [a - step * b for a, b in zip(now, g)]
    return best, history


def within_group_auc(df: DataFrame, keys: Sequence[str], group: str, label: str, score: str) -> DataFrame:
    """Per ``keys``: share of same-group (positive, negative) pairs in the
    right order, ties half, over all groups with both classes; and the pairs."""
    from .metrics import auc_table

    keys = list(keys)
    per = auc_table(df.filter(F.col(group).isNotNull()), label, score, [*keys, group])
    pairs = F.col("n_pos").cast("double") * (F.col("n_rows") - F.col("n_pos"))
    both = per.filter(F.col("roc_auc").isNotNull()).withColumn("__pairs", pairs)
    return both.groupBy(*keys).agg((F.sum(F.col("roc_auc") * F.col("__pairs")) / F.sum("__pairs")).alias("within_auc"), F.sum("__pairs").cast("long").alias("n_pairs"))
