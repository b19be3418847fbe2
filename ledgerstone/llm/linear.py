"""Hashed sparse logistic regression in NumPy: ``fit`` on rows at the driver, ``minimise`` on sums that come from elsewhere; calibration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: indices, values and the bounds of each row in them."""

    index: np.ndarray
    value: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(indices: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in indices])]).astype(np.int64)
        return Rows(np.concatenate(indices).astype(np.int32), np.concatenate(values).astype(np.float32), bounds)

    def take(self, rows: np.ndarray) -> Rows:
        cut = [slice(self.bounds[r], self.bounds[r + 1]) for r in rows]
        return Rows.of([self.index[c] for c in cut], [self.value[c] for c in cut])

    def dot(self, weights: np.ndarray, strip: int = 256) -> np.ndarray:
        """The product with weights, a strip of rows at a time."""
        out = np.zeros(len(self.bounds) - 1)
        for lo in range(0, len(out), strip):
            b = self.bounds[lo : lo + strip + 1]
            part = np.zeros(b[-1] - b[0] + 1)
            np.cumsum(weights[self.index[b[0] : b[-1]]] * self.value[b[0] : b[-1]], out=part[1:])
            out[lo : lo + strip] = part[b[1:] - b[0]] - part[b[:-1] - b[0]]
        return out

    def sums(self, per_row: np.ndarray, size: int, strip: int = 256) -> np.ndarray:
        """The product of a row vector with the rows."""
        out = np.zeros(size)
        for lo in range(0, len(per_row), strip):
            b = self.bounds[lo : lo + strip + 1]
            cut = slice(b[0], b[-1])
            out += np.bincount(self.index[cut], np.repeat(per_row[lo : lo + strip], np.diff(b)) * self.value[cut], size)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, target: np.ndarray, size: int, steps: int = 120, rate: float = 0.3, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias for soft targets in 0..1, both classes weighing the same, by Adam on all rows."""
    share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
    sample = target / share / 2 + (1 - target) / (1 - share) / 2
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        error = sample * (sigmoid(rows.dot(w) + b) - target) / len(target)
        g = rows.sums(error, size) + ridge * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        b -= step * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, steps: int = 30, memory: int = 8, still: float = 1e-5, least: float = 1e-8) -> np.ndarray:
    """Where a smooth convex function (value and gradient) is least, by L-BFGS from 0 with steps halved until they help; ends with a flat gradient or a step that gains too little."""
    x, past = np.zeros(size), []
    value, g = loss(x)
    for _ in range(steps):
        if np.abs(g).max(initial=0) < still:
            break
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        rate = 1.0
        while True:
            new, slope = loss(x + rate * d)
            if new <= value + 1e-4 * rate * (g @ d):
                break
            rate /= 2
            if rate < 1e-4:
                return x
        s, y, gain = rate * d, slope - g, value - new
        x, value, g = x + s, new, slope
        if gain < least:
            break
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
    return x


def platt(z: np.ndarray, target: np.ndarray, steps: int = 50, count: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset so that sigmoid(slope * z + offset) is calibrated, by Newton steps with smoothed targets; count: rows of each z and target."""
    count = np.ones(len(z)) if count is None else count
    n1, n0 = (count * target).sum(), (count * (1 - target)).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    y = np.where(target > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean = (count * z).sum() / count.sum()
    scale = max(float(np.sqrt((count * (z - mean) ** 2).sum() / count.sum())), 1e-9)
    x, theta = np.stack([z / scale, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ theta)
        h = (x * (count * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(h, x.T @ (count * (p - y)) + 1e-3 * (theta - [1, 0])), -2, 2)
    return float(theta[0] / scale), float(theta[1])
