"""Boosted one-split trees on logistic residuals with fixed positional thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.ordering import running_totals
from tideline.operators.blocks import Blocks, block_sum, unpack

SPLITS = 8


@dataclass(frozen=True)
class Boosted:
    name: str
    base: float
    stumps: tuple[tuple[str, float, float, float], ...]
    rate: float

    def margin(self) -> Column:
        total = F.lit(self.base)
        for feature, threshold, left, right in self.stumps:
            total = total + F.lit(self.rate) * F.when(F.col(feature) <= threshold, left).otherwise(right)
        return total


def thresholds(rows: DataFrame, features: list[str], period: str, cutoffs: list[int]) -> dict[int, list[tuple[int, float]]]:
    """Per cutoff the (feature, value) splits: order statistics at eight positions that end a run of equal values.

    Values are counted before the scan; what reaches the driver is at most
    eight numbers per feature and cutoff.
    """
    limits = F.array(*[F.lit(int(c)) for c in cutoffs])
    later = F.explode(F.filter(limits, lambda c: c > F.col(period)))
    # rows fold to value counts by period before they are dealt to the cutoffs
    tall = rows.select(period, F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "v"))
    folded = tall.groupBy(period, "f", "v").agg(F.count("*").alias("n"))
    counts = folded.withColumn("_c", later).groupBy("_c", "f", "v").agg(F.sum("n").alias("n"))
    sizes = rows.groupBy(period).agg(F.count("*").alias("n")).withColumn("_c", later).groupBy("_c").agg(F.sum("n").alias("size"))
    walked = running_totals(counts, ["_c", "f"], ["v"], {"upto": F.col("n")}).join(F.broadcast(sizes), "_c")
    places = F.transform(
        F.sequence(F.lit(1), F.lit(SPLITS)), lambda s: F.floor(s * (F.col("size") - 1) / F.lit(SPLITS + 1))
    )
    kept = walked.filter(F.array_contains(places, F.col("upto") - 1) & (F.col("upto") < F.col("size")))
    out: dict[int, list[tuple[int, float]]] = {int(c): [] for c in cutoffs}
    for r in kept.orderBy("_c", "f", "v").collect():
        out[int(r["_c"])].append((int(r["f"]), float(r["v"])))
    return out


def fit(
    blocks: Blocks, features: list[str], splits: dict[int, list[tuple[int, float]]], rounds: int = 12, rate: float = 0.08
) -> list[Boosted]:
    """One pass per round for all cutoffs: residual sums left of every split."""
    cutoffs = sorted(splits)
    index = {c: (np.array([f for f, _ in splits[c]], dtype=int), np.array([v for _, v in splits[c]])) for c in cutoffs}

    def totals(x, y, t):
        _, y, t = unpack(x, y, t)
        return np.concatenate([[(t < c).sum(), y[t < c].sum()] for c in cutoffs])

    sums = block_sum(blocks, 2 * len(cutoffs), totals).reshape(-1, 2)
    share = {c: s[1] / s[0] for c, s in zip(cutoffs, sums)}
    base = {c: math.log(max(p, 1e-6) / max(1.0 - p, 1e-6)) for c, p in share.items()}
    chosen: dict[int, list[tuple[int, float, float, float]]] = {c: [] for c in cutoffs}
    length = sum(2 * len(splits[c]) + 2 for c in cutoffs)
    for _ in range(rounds):
        state = {c: list(v) for c, v in chosen.items()}

        def residuals(x, y, t):
            x, y, t = unpack(x, y, t)
            parts = []
            for c in cutoffs:
                inside = t < c
                xs, ys = x[inside], y[inside]
                score = np.full(len(ys), base[c])
                for f, v, left, right in state[c]:
                    score += rate * np.where(xs[:, f] <= v, left, right)
                error = ys - 1.0 / (1.0 + np.exp(-score))
                f, v = index[c]
                below = (xs[:, f] <= v).astype(np.float64)
                parts += [error @ below, below.sum(0), [error.sum(), len(ys)]]
            return np.concatenate(parts)

        flat = block_sum(blocks, length, residuals)
        at = 0
        for c in cutoffs:
            k = len(splits[c])
            left_sum, left_n = flat[at : at + k], flat[at + k : at + 2 * k]
            total, n = flat[at + 2 * k], flat[at + 2 * k + 1]
            at += 2 * k + 2
            if k == 0:
                continue
            right_sum, right_n = total - left_sum, n - left_n
            best = int(np.argmin(-(left_sum**2) / left_n - right_sum**2 / right_n))
            f, v = splits[c][best]
            chosen[c].append((f, v, float(left_sum[best] / left_n[best]), float(right_sum[best] / right_n[best])))
    return [
        Boosted(str(c), base[c], tuple((features[f], v, a, b) for f, v, a, b in chosen[c]), rate) for c in cutoffs
    ]
