"""Distances, evidences and merge costs of feature arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contigua.functions.special import lgamma_col


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def weighted_mean(a: Column, na: Column, b: Column, nb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x * na + y * nb) / (na + nb))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def merge_counts(a: Column, b: Column) -> Column:
    """Union of two maps to counts, counts of common keys added."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def ward_cost(a: Column, na: Column, b: Column, nb: Column) -> Column:
    return na * nb / (na + nb) * square_distance(a, b)


def chisq_cost(a: Column, b: Column, weights: Column) -> Column:
    """Weighted squared distance of profiles; 0 where a row has no mass."""
    sa, sb = total(a), total(b)
    terms = F.zip_with(F.zip_with(a, b, lambda x, y: (x / sa - y / sb) * (x / sa - y / sb)), weights, lambda d, w: d * w)
    return F.when((sa == 0) | (sb == 0), F.lit(0.0)).otherwise(total(terms))


def dirichlet_multinomial(x: Column, beta: float = 1.0) -> Column:
    """Log evidence of counts under a symmetric Dirichlet prior, without the multinomial coefficient."""
    d = F.size(x).cast("double")
    terms = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + lgamma_col(v + beta))
    return lgamma_col(d * beta) + terms - d * lgamma_col(F.lit(float(beta))) - lgamma_col(total(x) + d * beta)


def multinomial_cost(a: Column, na: Column, b: Column, nb: Column, beta: float = 1.0) -> Column:
    lp = lambda x, n: dirichlet_multinomial(x, beta) + lgamma_col(n + 1.0)
    return lp(a, na) + lp(b, nb) - lp(added(a, b), na + nb)


def normal_gamma(x: Column, s: Column, n: Column, mu: Column, beta: Column, tau: float = 0.01, kappa: float = 1.0, halves: bool = True) -> Column:
    """Log evidence of rows with mean x and squared deviations s, each feature apart. halves: n / 2 is rounded down."""
    h = F.floor(n / 2).cast("double") if halves else n / 2
    kn = F.lit(kappa) + h
    part = F.zip_with(
        F.zip_with(s, F.zip_with(x, mu, lambda v, m: (v - m) * (v - m)), lambda sd, d2: F.struct(sd.alias("s"), d2.alias("d"))),
        beta,
        lambda v, b: lgamma_col(kn) - lgamma_col(F.lit(kappa)) + F.lit(kappa) * F.log(b) - kn * F.log(b + v["s"] / 2 + n * tau / (F.lit(tau) + n) / 2 * v["d"]) + 0.5 * F.log(F.lit(tau)) - 0.5 * F.log(F.lit(tau) + n) - h * 1.8378770664093453,
    )
    return total(part)


def gaussian_cost(a: Column, sa: Column, na: Column, b: Column, sb: Column, nb: Column, mu: Column, beta: Column, tau: float = 0.01, kappa: float = 1.0) -> Column:
    x = weighted_mean(a, na, b, nb)
    s = F.zip_with(added(sa, sb), F.zip_with(F.zip_with(a, x, lambda p, q: (p - q) * (p - q) * na), F.zip_with(b, x, lambda p, q: (p - q) * (p - q) * nb), lambda p, q: p + q), lambda p, q: p + q)
    ng = lambda x, s, n: normal_gamma(x, s, n, mu, beta, tau, kappa)
    return ng(a, sa, na) + ng(b, sb, nb) - ng(x, s, na + nb)


def prior_k(n: Column, k: Column) -> Column:
    """Log prior of k clusters of n rows: ln gamma(n + 1) - ln C(n - 1, k - 1) - ln gamma(k + 1)."""
    choose = lgamma_col(n) - lgamma_col(k) - lgamma_col(n - k + 1)
    return lgamma_col(n + 1) - choose - lgamma_col(k + 1)
