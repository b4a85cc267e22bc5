"""Ridge-penalised generalised linear models by reweighted least squares, with Laplace evidence, for each group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigua.functions.special import lgamma

LN_2PI = 1.8378770664093453


def _log1pexp(e: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, e)


@dataclass(frozen=True)
class Family:
    """Mean, derivative of the mean and variance at a linear predictor, and log likelihood of each row."""

    mean: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray]
    variance: Callable[[np.ndarray], np.ndarray]
    log_lik: Callable[[np.ndarray, np.ndarray], np.ndarray]


_COUNTS = Family(np.exp, np.exp, lambda m: m, lambda e, y: e * y - np.exp(e) - lgamma(y + 1))
#: Counts with a log link, chances with a logit link, and positive amounts of dispersion one with a log link.
FAMILIES = {
    "poisson": _COUNTS,
    "binomial": Family(lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-np.abs(e)) / (1 + np.exp(-np.abs(e))) ** 2, lambda m: m * (1 - m), lambda e, y: e * y - _log1pexp(e)),
    "gamma": Family(np.exp, np.exp, lambda m: m**2, lambda e, y: -y * np.exp(-e) - e),
}


def family_of(name: str, published: bool = False) -> Family:
    """The family of a name; the published program models counts under each of the three names."""
    if name not in FAMILIES:
        raise ValueError("Family not available.")
    return _COUNTS if published else FAMILIES[name]


@dataclass
class Fit:
    beta: np.ndarray
    penalty: float
    h: np.ndarray
    inverse: np.ndarray
    rows: int
    steps: int


def fit(x: np.ndarray, y: np.ndarray, family: str = "poisson", penalty: float = 0.01, most: int = 100, near: float = 1e-6, published: bool = False) -> Fit:
    f = family_of(family, published)
    beta = np.zeros(x.shape[1])
    for step in range(most):
        eta = x @ beta
        mu, slope = f.mean(eta), f.slope(eta)
        w = slope**2 / f.variance(mu)
        h = (x * w[:, None]).T @ x + penalty * np.eye(len(beta))
        new = np.linalg.solve(h, x.T @ (w * eta + w * (y - mu) / slope))
        moved, beta = np.linalg.norm(new - beta), new
        if moved < near:
            break
    return Fit(beta, penalty, h, np.linalg.inv(h), len(y), step)


def log_likelihood(x: np.ndarray, y: np.ndarray, beta: np.ndarray, family: str = "poisson") -> np.ndarray:
    return family_of(family).log_lik(x @ beta, y)


def laplace_evidence(x: np.ndarray, y: np.ndarray, f: Fit, family: str = "poisson") -> float:
    """Log likelihood at the mode plus the Gaussian volume; the prior's density isn't part of it."""
    return float(log_likelihood(x, y, f.beta, family).sum() + 0.5 * len(f.beta) * LN_2PI + 0.5 * np.linalg.slogdet(f.inverse)[1])


def log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float:
    r = x - mean
    return float(-0.5 * len(x) * LN_2PI - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * r @ np.linalg.solve(cov, r))


def merge_change(one: Fit, two: Fit, penalty: float) -> float:
    """Change of the evidence when two fits with Gaussian posteriors become one."""
    cov = np.linalg.inv(one.h + two.h)
    beta = cov @ (one.h @ one.beta + two.h @ two.beta)
    rest = np.eye(len(beta)) / penalty - cov
    d = len(beta)
    return float(-np.linalg.slogdet(rest)[1] - d * np.log(penalty) + log_normal(one.beta, two.beta, one.inverse + two.inverse) - log_normal(np.zeros(d), beta, rest))


def fit_groups(rows: DataFrame, key: str, x: list[str], y: str, penalty: float = 0.01, family: str = "poisson") -> DataFrame:
    """(key, beta, evidence, n, steps): one regression with intercept for each group; a group must fit in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.column_stack([np.ones(len(pdf)), pdf[x].to_numpy(float)])
        t = pdf[y].to_numpy(float)
        f = fit(m, t, family, penalty)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "beta": [f.beta.tolist()], "evidence": [laplace_evidence(m, t, f, family)], "n": [f.rows], "steps": [f.steps]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *x, y).dropna().groupBy(key).applyInPandas(run, f"{key} {kind}, beta array<double>, evidence double, n bigint, steps bigint")


#: Link functions on columns: (link, inverse, derivative of the inverse).
LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "logit": (lambda m: F.log(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(e) / F.pow(F.exp(e) + 1, 2)),
    "log": (F.log, F.exp, F.exp),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / F.pow(e, 2)),
    "sqrt": (F.sqrt, lambda e: F.pow(e, 2), lambda e: 2 * e),
}


def probit(mu: Column, upper: bool = False) -> Column:
    """Normal quantile, as an Arrow-batched function; upper: of the upper tail, which turns the sign."""
    sign = -1.0 if upper else 1.0

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda p: sign * NormalDist().inv_cdf(p) if p is not None and 0 < p < 1 else float("nan"))

    return run(mu)
