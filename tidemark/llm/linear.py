"""Small linear models fitted on bounded samples on the driver (numpy).

All fits are full-batch and start from zero, so they are deterministic.
A fit holds its sample and one scaled copy (float32); whatever needs double
precision is done in blocks, so no third matrix is made.
"""

from __future__ import annotations

import numpy as np

#: Columns, or rows, that are widened to double precision at once.
BLOCK = 256


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class Scaler:
    """Centres and scales columns; ``fold`` turns weights back to raw columns."""

    def __init__(self, x: np.ndarray):
        self.mean, sd = np.empty(x.shape[1]), np.empty(x.shape[1])
        for c in range(0, x.shape[1], BLOCK):
            part = x[:, c : c + BLOCK].astype(np.float32)
            self.mean[c : c + BLOCK] = part.mean(axis=0, dtype=np.float64)
            sd[c : c + BLOCK] = part.std(axis=0, dtype=np.float64)
        # Columns that hardly vary would be blown up by their own scale.
        self.scale = np.maximum(sd, max(float(np.median(sd)), 1e-12) * 0.25)

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.float32)
        for r in range(0, len(x), BLOCK):
            out[r : r + BLOCK] = (x[r : r + BLOCK] - self.mean) / self.scale
        return out

    def fold(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        raw = w / self.scale
        return raw, float(b - raw @ self.mean)


def products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` in double precision."""
    out = np.empty(len(x))
    for r in range(0, len(x), BLOCK):
        out[r : r + BLOCK] = x[r : r + BLOCK].astype(np.float64) @ w
    return out


def _descend(x: np.ndarray, slope, l2: float, curve: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent; ``slope(z)`` is the loss derivative by row, ``curve`` its bound."""
    n, d = x.shape
    v = np.ones(d, np.float32)
    for _ in range(12):  # largest eigenvalue of x'x / n
        v = x.T @ (x @ v) / n
        v /= np.linalg.norm(v) + 1e-12
    top = float(np.linalg.norm(x @ v) ** 2 / n) + 1.0
    rate = 1.0 / (1.1 * curve * top + l2)
    w, b = np.zeros(d), 0.0
    pw, pb = w, b
    for k in range(steps):
        m = k / (k + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        g = slope(x @ yw.astype(np.float32) + yb)
        pw, pb = w, b
        w = yw - rate * (x.T @ g.astype(np.float32) / n + l2 * yw)
        b = yb - rate * float(g.mean())
    return w, b


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression; ``y`` may be soft (0 to 1)."""
    return _descend(x, lambda z: sigmoid(z) - y, l2, 0.25, steps)


def fit_svm(x: np.ndarray, side: np.ndarray, l2: float = 1e-2, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear support vector machine (squared hinge); ``side`` is -1 or 1."""
    return _descend(x, lambda z: -2.0 * side * np.maximum(0.0, 1.0 - side * z), l2, 2.0, steps)


def fit_platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Calibration a, b with P(1) = sigmoid(a * z + b), by Newton steps on smoothed targets."""
    if len(z) == 0:
        return 1.0, 0.0
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(z)) or 1.0
    u = z / scale
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(steps):
        p = sigmoid(a * u + b)
        g = np.array([((p - t) * u).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * u * u).sum() + 1e-3, (q * u).sum()], [(q * u).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return a / scale, b
