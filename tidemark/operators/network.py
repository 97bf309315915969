"""Dense networks with row weights, class weights and early stop.

All folds' networks are fitted side by side on one stored table that holds
every row once, packed in blocks: a row carries one role (train, valid or none)
per model.  A step is one job: each task runs its rows forward and backward in
numpy, block by block, and gives one row of sums per model (loss and weight of train and
valid rows, gradient of the train rows); Spark adds them up by position.  The
driver holds parameters only, so nothing there grows with the rows, and a lost
task is run again from the stored table.

The loss is the weighted logistic loss, positives times ``pos_weight``.  Steps
are full-batch Adam with decoupled weight decay and clipped gradients.  After
``patience`` steps without a smaller valid loss a model stops; the parameters
with the smallest one are kept.  A model without valid rows takes all steps.

Rows with a missing label, feature or weight, or a weight of 0 or less, take
no part in a fit; a row with a missing feature gets a null score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import packed

TRAIN, VALID = 1, 2

#: Rows of one stored block.
BLOCK_ROWS = 8192


@dataclass
class Network:
    """Sizes of the layers, and the parameters as one flat vector."""

    sizes: tuple[int, ...]
    flat: np.ndarray
    best_step: int = 0
    steps_run: int = 0
    pos_weight: float = 1.0
    train_losses: list[float] = field(default_factory=list)
    valid_losses: list[float] = field(default_factory=list)


def start(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Seeded normal weights of deviation sqrt(2 / inputs), zero intercepts."""
    rng = np.random.default_rng(seed)
    parts = [p for a, b in zip(sizes, sizes[1:]) for p in (rng.normal(0, math.sqrt(2 / max(a, 1)), a * b), np.zeros(b))]
    return np.concatenate(parts)


def layers(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, intercepts) per layer, as views of ``flat``."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, flat: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-odds, and the inputs of every layer (rectified)."""
    seen, z = [x], x
    parts = layers(flat, sizes)
    for i, (w, b) in enumerate(parts):
        z = seen[-1] @ w + b
        if i + 1 < len(parts):
            seen.append(np.maximum(z, 0.0))
    return z[:, 0], seen


def losses(z: np.ndarray, y: np.ndarray, w: np.ndarray, pos_weight: float) -> np.ndarray:
    """Weighted logistic loss per row."""
    return w * (pos_weight * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z))


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, flat: np.ndarray, sizes: Sequence[int], pos_weight: float) -> tuple[float, np.ndarray]:
    """Summed loss of the rows, and its derivative by ``flat``."""
    z, seen = forward(x, flat, sizes)
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    back = (w * ((1 - y) * p - pos_weight * y * (1 - p)))[:, None]
    grads, parts = [], layers(flat, sizes)
    for i in reversed(range(len(parts))):
        grads += [back.sum(axis=0), (seen[i].T @ back).ravel()]
        if i:  # nothing stands below the first layer
            back = (back @ parts[i][0].T) * (seen[i] > 0)
    return float(losses(z, y, w, pos_weight).sum()), np.concatenate(grads[::-1])


def _blocks(data: DataFrame, n: int) -> DataFrame:
    """Rows of (x, y, w, roles) in packed blocks, stored."""
    names = ["mask", "wide", "narrow", "y", "w", "roles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                y, w = (part.column(i).to_numpy(zero_copy_only=False).tobytes() for i in (1, 2))
                roles = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                cells = [*packed.pack(packed.matrix(part.column(0), n)), y, w, roles]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=names)

    return cut_lineage(data.mapInArrow(run, ", ".join(f"{c} binary" for c in names)))


def _pass(rows: DataFrame, nets: dict[int, Network]) -> dict[int, np.ndarray]:
    """Per model: train loss, train weight, valid loss, valid weight and gradient, summed over all rows of the blocks."""
    given = {m: (net.flat, net.sizes, net.pos_weight) for m, net in nets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(4 + len(flat)) for m, (flat, _, _) in given.items()}
        for mask, wide, narrow, *rest in packed.rows(batches):
            y, w = (np.frombuffer(c) for c in rest[:2])
            x = packed.unpack(mask, wide, narrow, len(y))
            roles = np.frombuffer(rest[2], np.uint8).reshape(len(y), -1)
            for m, (flat, sizes, pos) in given.items():
                own = roles[:, m] == TRAIN
                if own.any():
                    loss, grad = gradient(x[own], y[own], w[own], flat, sizes, pos)
                    sums[m][:2] += loss, w[own].sum()
                    sums[m][4:] += grad
                own = roles[:, m] == VALID
                if own.any():
                    sums[m][2:4] += losses(forward(x[own], flat, sizes)[0], y[own], w[own], pos).sum(), w[own].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["model", "sums"])

    parts = rows.mapInArrow(run, "model int, sums array<double>").select("model", F.posexplode("sums"))
    got = parts.groupBy("model", "pos").agg(F.sum("col").alias("v")).toArrow()
    model, pos, v = (got.column(c).to_numpy() for c in ("model", "pos", "v"))
    out = {m: np.zeros(4 + len(net.flat)) for m, net in nets.items()}
    for m in out:
        out[m][pos[model == m]] = v[model == m]
    return out


def fit_networks(
    rows: DataFrame,
    models: dict[str, tuple[Column, Column]],
    x: str,
    label: str,
    n_features: int,
    weight: str | None = None,
    hidden: Sequence[int] = (32, 16),
    steps: int = 60,
    patience: int = 8,
    min_delta: float = 1e-4,
    rate: float = 0.02,
    weight_decay: float = 1e-4,
    grad_clip: float = 5.0,
    pos_weight: str = "sqrt",
    seed: int = 42,
) -> dict[str, Network]:
    """One network per entry of ``models``: name -> (condition of train rows,
    of valid rows).  ``x`` is an array of ``n_features`` doubles.

    ``pos_weight`` is none (1), sqrt or balanced: (the root of) the weight of
    the negative train rows over that of the positive ones."""
    if pos_weight not in ("none", "sqrt", "balanced"):
        raise ValueError(f"unknown pos_weight {pos_weight}")
    names = list(models)
    roles = F.array(*[F.when(t, TRAIN).when(v, VALID).otherwise(0) for t, v in models.values()])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size(x) == n_features)
    data = rows.select(F.col(x).cast("array<double>").alias("x"), y.alias("y"), w.alias("w"), roles.alias("roles")).filter(
        y.isin(0.0, 1.0) & (w > 0) & ~F.isnan(w) & whole & (F.array_max(roles) > 0))
    blocks = _blocks(data, n_features)
    is_train = [F.get("roles", F.lit(i)) == TRAIN for i in range(len(names))]
    mass = data.agg(*[F.sum(F.when(c & (F.col("y") == k), F.col("w"))).alias(f"m{i}_{k}") for i, c in enumerate(is_train) for k in (0, 1)]).first()
    sizes = (n_features, *hidden, 1)
    nets: dict[int, Network] = {}
    for i in range(len(names)):
        neg, pos = (mass[f"m{i}_{k}"] or 0.0 for k in (0, 1))
        ratio = neg / pos if pos_weight != "none" and neg > 0 and pos > 0 else 1.0
        nets[i] = Network(sizes, start(sizes, seed), pos_weight=math.sqrt(ratio) if pos_weight == "sqrt" else ratio)
    best = {i: net.flat for i, net in nets.items()}
    mean, square = ({i: np.zeros(len(net.flat)) for i, net in nets.items()} for _ in range(2))
    active = {i for i in nets if mass[f"m{i}_0"] or mass[f"m{i}_1"]}
    # Weights decay, intercepts don't.
    decays = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:])])
    # The last pass only measures the last step's parameters.
    for t in range(1, steps + 2):
        if not active:
            break
        sums = _pass(blocks, {i: nets[i] for i in active})
        for i in sorted(active):
            net, s = nets[i], sums[i]
            net.train_losses.append(s[0] / s[1])
            if s[3] > 0:
                net.valid_losses.append(s[2] / s[3])
                if net.best_step == 0 and t == 1 or net.valid_losses[-1] < net.valid_losses[net.best_step] - min_delta:
                    net.best_step, best[i] = t - 1, net.flat
                elif t - 1 - net.best_step >= patience:
                    active.discard(i)
            else:
                net.best_step, best[i] = t - 1, net.flat
            if i not in active or t > steps:
                continue
            g = s[4:] / s[1]
            g = g * min(1.0, grad_clip / (np.linalg.norm(g) + 1e-12))
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            step = (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
            net.flat = net.flat - rate * (step + weight_decay * decays * net.flat)
            net.steps_run = t
    for i, net in nets.items():
        net.flat = best[i]
    return {name: nets[i] for i, name in enumerate(names)}


def network_score(model: Column, x: Column, nets: dict[str, Network]) -> Column:
    """Probability under the network that ``model`` names, in Arrow batches;
    null for any other name or a missing feature."""
    given = {str(m): (net.flat, net.sizes) for m, net in nets.items()}

    @F.pandas_udf("double")
    def score(names: pd.Series, xs: pd.Series) -> pd.Series:
        out = np.full(len(names), np.nan)
        asked = names.to_numpy()
        for m, (flat, sizes) in given.items():
            at = np.flatnonzero(asked == m)
            at = at[[xs.iloc[i] is not None and len(xs.iloc[i]) == sizes[0] for i in at]] if len(at) else at
            if len(at):
                z = forward(np.stack([np.asarray(xs.iloc[i], float) for i in at]), flat, sizes)[0]
                out[at] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return pd.Series(out)

    found = score(model.cast("string"), x)
    return F.when(~F.isnan(found), found)
