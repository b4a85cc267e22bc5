"""Laplace approximation of the evidence of Dirichlet rows under an exponential prior, in beta = ln(alpha - 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from contigua.functions.special import digamma, lgamma, trigamma

LN_2PI = 1.8378770664093453


def log_norm(alpha: np.ndarray) -> np.ndarray:
    """Log normaliser of Dirichlet densities; the last axis holds the components."""
    return lgamma(alpha.sum(axis=-1)) - lgamma(alpha).sum(axis=-1)


def log_posterior(beta: np.ndarray, n: np.ndarray, lam: np.ndarray, lpi: np.ndarray) -> np.ndarray:
    e = np.exp(beta)
    return (e * (lpi - lam)).sum(-1) + np.log(lam).sum(-1) + n * log_norm(e + 1) + beta.sum(-1)


def gradient(beta: np.ndarray, n: np.ndarray, lam: np.ndarray, lpi: np.ndarray) -> np.ndarray:
    e = np.exp(beta)
    n = np.asarray(n, float)[..., None]
    return e * (n * digamma((e + 1).sum(-1))[..., None] - n * digamma(e + 1) + lpi - lam) + 1


def hessian_parts(beta: np.ndarray, n: np.ndarray, lam: np.ndarray, lpi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Hessian as diagonal d plus z e e', e = exp(beta)."""
    e = np.exp(beta)
    d = gradient(beta, n, lam, lpi) - np.asarray(n, float)[..., None] * e**2 * trigamma(e + 1) - 1
    return d, n * trigamma((e + 1).sum(-1))


def log_det(beta: np.ndarray, n: np.ndarray, lam: np.ndarray, lpi: np.ndarray) -> np.ndarray:
    """ln |det H| by the matrix determinant lemma."""
    d, z = hessian_parts(beta, n, lam, lpi)
    return np.log(1 + z * (np.exp(2 * beta) / d).sum(-1)) + np.log(np.abs(d)).sum(-1)


def hessian(beta: np.ndarray, n: float, lam: np.ndarray, lpi: np.ndarray) -> np.ndarray:
    d, z = hessian_parts(beta, n, lam, lpi)
    e = np.exp(beta)
    return z * np.outer(e, e) + np.diag(d)


def inverse_hessian(beta: np.ndarray, n: float, lam: np.ndarray, lpi: np.ndarray) -> np.ndarray:
    """By the Sherman-Morrison formula."""
    d, z = hessian_parts(beta, n, lam, lpi)
    u = np.exp(beta) / d
    return np.diag(1 / d) - np.outer(u, u) / (1 / z + (np.exp(beta) * u).sum())


def laplace(beta: np.ndarray, n: np.ndarray, lam: np.ndarray, lpi: np.ndarray, halves: bool = True, most: int = 50, near: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta at the mode, log evidence, steps) by Newton steps on a whole batch at once.

    A row stops when its posterior moves by less than `near`; a step that lowers it or makes it NaN is taken back and
    ends the row. halves: D / 2 is rounded down.
    """
    beta, n = np.array(beta, float), np.asarray(n, float)
    value = log_posterior(beta, n, lam, lpi)
    live, steps = np.ones(len(beta), bool), np.zeros(len(beta), int)
    for _ in range(most + 1):
        if not live.any():
            break
        b, k, l = beta[live], n[live], lpi[live]
        d, z = hessian_parts(b, k, lam, l)
        g = gradient(b, k, lam, l)
        e = np.exp(b)
        u = e / d
        step = g / d - u * ((u * g).sum(-1) / (1 / z + (e * u).sum(-1)))[:, None]
        with np.errstate(all="ignore"):
            after = log_posterior(b - step, k, lam, l)
        old, rows = value[live], np.flatnonzero(live)
        bad = ~np.isfinite(after) | ((after < old) & (np.abs(after - old) > near))
        beta[rows[~bad]], value[rows[~bad]] = (b - step)[~bad], after[~bad]
        steps[rows] += 1
        live[rows[bad | (np.abs(after - old) < near)]] = False
    d = beta.shape[1]
    return beta, log_posterior(beta, n, lam, lpi) + (d // 2 if halves else d / 2) * LN_2PI - 0.5 * log_det(beta, n, lam, lpi), steps


def evidence(n: np.ndarray, lam: np.ndarray, lpi: np.ndarray, mean: np.ndarray, halves: bool = True) -> np.ndarray:
    """Log evidence of n rows with summed logarithms lpi and mean composition `mean`, for a batch."""
    n, d = np.asarray(n, float), mean.shape[1]
    free = n * (d - 1) / (-2 * (mean * ((lpi - lam) - n[:, None] * np.log(mean))).sum(-1))
    scale = np.maximum(free, 100 / mean.min(-1))
    return laplace(np.log(scale[:, None] * mean - 1), n, lam, lpi, halves)[1]


def evidence_col(n: Column, lpi: Column, mean: Column, lam: float = 0.01) -> Column:
    """The evidence as an Arrow-batched column function."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, l, m in batches:
            if len(k):
                mm = np.stack(m.to_numpy())
                yield pd.Series(evidence(k.to_numpy(float), np.full(mm.shape[1], lam), np.stack(l.to_numpy()), mm))
            else:
                yield pd.Series([], dtype=float)

    return run(n.cast("double"), lpi, mean)
