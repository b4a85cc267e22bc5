"""Gamma functions: on numpy arrays, and as Column expressions that stay in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for ln gamma: B(2k) / (2k (2k - 1)); fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8
HALF_LN_2PI = 0.9189385332046727
#: Coefficients of the asymptotic series of digamma (after ln x - 1/2x) and trigamma (after 1/x + 1/2x^2); fixed values.
DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)


def lgamma(x: np.ndarray | float) -> np.ndarray:
    """ln gamma for x > 0: shifted by eight, then Stirling's series."""
    x = np.asarray(x, float)
    small = x < 1e4
    y = np.where(small, x + SHIFT, x)
    prod = np.ones_like(y)
    low = np.where(small, x, 1.0)
    for k in range(SHIFT):
        prod = prod * (low + k)
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(STIRLING))
    return (y - 0.5) * np.log(y) - y + HALF_LN_2PI + series - np.where(small, np.log(prod), 0.0)


def digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float)
    back = sum(1 / (x + k) for k in range(SHIFT))
    y = x + SHIFT
    return np.log(y) - 0.5 / y + sum(c / y ** (2 * k + 2) for k, c in enumerate(DIGAMMA)) - back


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float)
    back = sum(1 / (x + k) ** 2 for k in range(SHIFT))
    y = x + SHIFT
    return 1 / y + 0.5 / y**2 + sum(c / y ** (2 * k + 3) for k, c in enumerate(TRIGAMMA)) + back


def lgamma_col(x: Column) -> Column:
    """ln gamma of a positive column, within 4e-12 of max(1, |value|)."""
    y = x + F.lit(float(SHIFT))
    prod = x
    for k in range(1, SHIFT):
        prod = prod * (x + F.lit(float(k)))
    series = F.lit(0.0)
    for k, c in enumerate(STIRLING[:4]):
        series = series + F.lit(c) / F.pow(y, F.lit(float(2 * k + 1)))
    near = (y - 0.5) * F.log(y) - y + HALF_LN_2PI + series - F.log(prod)
    far = (x - 0.5) * F.log(x) - x + HALF_LN_2PI + F.lit(STIRLING[0]) / x
    return F.when(x < 1e4, near).otherwise(far)


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
