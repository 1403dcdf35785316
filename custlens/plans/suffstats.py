"""Sufficient statistics for linear models.

One aggregate pass gives, per group, the count, the column sums and the
cross-product matrix of a list of column expressions (centred by given
constants for numerical stability).  Everything a linear model needs - fit,
standard errors, fit statistics, the SSE of a fitted model on another subset -
follows from these p x p numbers on the driver.  The row data never moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 400


@dataclass(frozen=True)
class Moments:
    n: float
    s: np.ndarray  # column sums of z
    m: np.ndarray  # sum of z z'

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.s + other.s, self.m + other.m)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.s - other.s, self.m - other.m)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and the within-subset centred cross-product matrix."""
        mean = self.s / self.n
        return mean, self.m - self.n * np.outer(mean, mean)


def moments(
    df: DataFrame, exprs: Sequence[Column], center: Sequence[float] | None = None, group: Column | None = None
) -> dict:
    """{group value (or None): Moments} for z = exprs - center.

    One ``agg`` with p(p+1)/2 + p + 1 sums (per group when ``group`` is set);
    only that aggregate row per group reaches the driver."""
    p = len(exprs)
    if p > MAX_TERMS:
        raise ValueError(f"too many model terms ({p} > {MAX_TERMS})")
    c = list(center) if center is not None else [0.0] * p
    z = [(e - F.lit(float(ci))).alias(f"_z{i}") for i, (e, ci) in enumerate(zip(exprs, c))]
    base = df.select(*(([group.alias("_g")] if group is not None else []) + z))
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(f"_z{i}").alias(f"_s{i}") for i in range(p)]
    aggs += [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_m{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = (base.groupBy("_g").agg(*aggs) if group is not None else base.agg(*aggs)).collect()
    out = {}
    for r in rows:
        if not r["_n"]:
            continue
        s = np.array([r[f"_s{i}"] for i in range(p)], dtype=float)
        m = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                m[i, j] = m[j, i] = r[f"_m{i}_{j}"]
        out[r["_g"] if group is not None else None] = Moments(float(r["_n"]), s, m)
    if group is None and not out:
        out[None] = Moments(0.0, np.zeros(p), np.zeros((p, p)))
    return out


def column_means(df: DataFrame, exprs: Sequence[Column]) -> list[float]:
    row = df.agg(*[F.avg(e).alias(f"_a{i}") for i, e in enumerate(exprs)]).collect()[0]
    return [float(row[f"_a{i}"]) if row[f"_a{i}"] is not None else 0.0 for i in range(len(exprs))]


@dataclass(frozen=True)
class LinearFit:
    """OLS with intercept in the original units; the last moment column is y."""

    beta: np.ndarray  # slopes
    intercept: float
    xtx_inv: np.ndarray  # inverse centred X'X
    x_mean: np.ndarray
    n: float
    rss: float
    tss: float
    rank: int


def solve(mom: Moments, center: Sequence[float]) -> LinearFit:
    """Least squares from the moments; without rows every estimate is NaN."""
    k = len(mom.s) - 1
    if not mom.n:
        nan = float("nan")
        return LinearFit(np.full(k, nan), nan, np.full((k, k), nan), np.full(k, nan), 0.0, nan, nan, 0)
    mean, c = mom.centred()
    cxx, cxy = c[:k, :k], c[:k, k]
    inv = np.linalg.pinv(cxx) if k else np.zeros((0, 0))
    beta = inv @ cxy if k else np.zeros(0)
    rank = int(np.linalg.matrix_rank(cxx)) if k else 0
    cen = np.asarray(center, dtype=float)
    x_mean = mean[:k] + cen[:k]
    y_mean = mean[k] + cen[k]
    intercept = float(y_mean - x_mean @ beta) if k else float(y_mean)
    tss = float(c[k, k])
    rss = float(max(tss - beta @ cxy, 0.0)) if k else tss
    return LinearFit(beta, intercept, inv, x_mean, mom.n, rss, tss, rank)


def sse_on(fit: LinearFit, mom: Moments, center: Sequence[float]) -> float:
    """Sum of squared errors of ``fit`` over the rows summarised by ``mom``."""
    cen = np.asarray(center, dtype=float)
    k = len(fit.beta)
    a = fit.intercept - cen[k] + cen[:k] @ fit.beta
    w = np.concatenate([-fit.beta, [1.0]])
    return float(w @ mom.m @ w - 2 * a * (w @ mom.s) + mom.n * a * a)
