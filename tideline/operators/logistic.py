"""Logistic models by full-batch gradient descent with a fixed number of epochs.

Several models (refit dates, feature subsets) over one training table are
fitted together: an epoch is one pass, over blocks that the executors keep, which
returns all their gradients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.scalar import sigmoid
from tideline.operators.blocks import Blocks, block_descent, block_sum, unpack


@dataclass(frozen=True)
class Spec:
    """Which rows (``first <= period < before``) and features a model uses, and its step rule."""

    name: str
    first: float
    before: float
    features: tuple[int, ...]
    epochs: int
    rate: float
    l2: float
    unit_floor: bool = False  # a constant feature gets scale 1 instead of 1e-9
    balanced: bool = False  # weigh positives by negatives / positives


@dataclass(frozen=True)
class Linear:
    name: str
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    rows: int

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.means, self.scales, self.weights):
            total = total + F.lit(w) * ((F.col(f) - F.lit(m)) / F.lit(s))
        return total

    def probability(self) -> Column:
        return sigmoid(self.margin())


def _stable_sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))


def fit(blocks: Blocks, names: list[str], specs: list[Spec]) -> list[Linear]:
    width, models = len(names), len(specs)
    first = np.array([s.first for s in specs])
    before = np.array([s.before for s in specs])
    used = np.zeros((models, width))
    for m, s in enumerate(specs):
        used[m, list(s.features)] = 1.0

    def member(t):
        return ((t[:, None] >= first) & (t[:, None] < before)).astype(np.float64)

    def counts(x, y, t):
        x, y, t = unpack(x, y, t)
        w = member(t)
        return np.concatenate([w.sum(0), w.T @ y, (w.T @ x).ravel()])

    sums = block_sum(blocks, models * (2 + width), counts)
    n, positives = sums[:models], sums[models : 2 * models]
    if np.any(n == 0) or np.any(positives == 0):
        raise ValueError("a model has no training rows or no positive rows")
    means = sums[2 * models :].reshape(models, width) / n[:, None]

    def spread(x, y, t):
        x, y, t = unpack(x, y, t)
        w = member(t)
        return np.stack([w[:, m] @ (x - means[m]) ** 2 for m in range(models)]).ravel()

    variance = block_sum(blocks, models * width, spread).reshape(models, width) / n[:, None]
    unit = np.array([s.unit_floor for s in specs])[:, None]
    scales = np.where(unit, np.where(variance > 1e-12, np.sqrt(variance), 1.0), np.maximum(np.sqrt(variance), 1e-9))
    lift = np.where([s.balanced for s in specs], (n - positives) / positives, 1.0)
    size = np.where([s.balanced for s in specs], (n - positives) + lift * positives, n)
    rate = np.array([s.rate for s in specs])
    l2 = np.array([s.l2 for s in specs])
    epochs = np.array([s.epochs for s in specs])

    def parts(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return state[models:].reshape(models, width), state[:models]

    def gradient(state, x, y, t):
        weights, intercept = parts(state)
        x, y, t = unpack(x, y, t)
        slope = weights / scales
        error = _stable_sigmoid(x @ slope.T + (intercept - (slope * means).sum(1))) - y[:, None]
        error *= member(t) * np.where(y[:, None] == 1, lift, 1.0)
        return np.concatenate([error.sum(0), (error.T @ x).ravel()])

    def step(epoch, state, total):
        weights, intercept = parts(state)
        slopes, bias = parts(total)
        slopes = (slopes - means * bias[:, None]) / scales
        live = epoch < epochs
        moved = rate[:, None] * (slopes / size[:, None] + l2[:, None] * weights) * used
        return np.concatenate([intercept - live * rate * bias / size, (weights - live[:, None] * moved).ravel()])

    weights, intercept = parts(block_descent(blocks, np.zeros(models * (1 + width)), int(epochs.max()), gradient, step))
    if not (np.isfinite(weights).all() and np.isfinite(intercept).all()):
        raise ValueError("logistic fit produced a non-finite parameter")
    out = []
    for m, s in enumerate(specs):
        j = list(s.features)
        out.append(
            Linear(
                s.name, tuple(names[i] for i in j), tuple(map(float, means[m, j])), tuple(map(float, scales[m, j])),
                tuple(map(float, weights[m, j])), float(intercept[m]), int(n[m]),
            )
        )
    return out


def coefficients(spark, models: list[Linear]) -> DataFrame:
    """(model, feature, mean, scale, weight) table with the intercept as a feature row."""
    rows = []
    for m in models:
        rows.append((m.name, "intercept", 0.0, 1.0, m.intercept, m.rows))
        rows += [(m.name, f, a, b, w, m.rows) for f, a, b, w in zip(m.features, m.means, m.scales, m.weights)]
    return spark.createDataFrame(rows, "model string, feature string, mean double, scale double, weight double, n_rows long")
