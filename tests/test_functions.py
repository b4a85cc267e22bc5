import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigua.functions import dirichlet as dr
from contigua.functions import glm
from contigua.functions.special import digamma, lgamma, lgamma_col, log_add, trigamma


def test_lgamma_matches_math():
    xs = np.array([1e-3, 0.1, 0.5, 1, 2, 3.7, 10, 123.4, 9999, 10001, 1e6, 1e8])
    want = np.array([math.lgamma(x) for x in xs])
    assert np.all(np.abs(lgamma(xs) - want) <= 1e-11 * np.maximum(1, np.abs(want)))


def test_digamma_and_trigamma_are_derivatives():
    xs = np.array([0.05, 0.7, 1.0, 5.5, 80.0])
    h = 1e-5
    assert np.allclose(digamma(xs), (lgamma(xs + h) - lgamma(xs - h)) / (2 * h), rtol=1e-5)
    assert np.allclose(trigamma(xs), (digamma(xs + h) - digamma(xs - h)) / (2 * h), rtol=1e-5)


def test_column_functions(spark):
    xs = [1e-3, 0.5, 1.0, 42.0, 5e3, 2e4, 1e8]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma_col(F.col("x"))).collect()]
    assert all(abs(g - math.lgamma(x)) <= 4e-12 * max(1, abs(math.lgamma(x))) * 10 for g, x in zip(got, xs))
    assert abs(spark.range(1).select(log_add(F.lit(1000.0), F.lit(1000.0))).first()[0] - (1000 + math.log(2))) < 1e-9


def test_dirichlet_gradient_and_hessian():
    rng = np.random.default_rng(0)
    lam, x = np.full(4, 0.01), rng.dirichlet([2, 3, 4, 5], size=30)
    lpi, beta, n, h = np.log(x).sum(0), rng.normal(size=4), 30.0, 1e-5
    num = [(dr.log_posterior(beta + h * e, n, lam, lpi) - dr.log_posterior(beta - h * e, n, lam, lpi)) / (2 * h) for e in np.eye(4)]
    assert np.allclose(dr.gradient(beta, n, lam, lpi), num, rtol=1e-4)
    hes = [(dr.gradient(beta + h * e, n, lam, lpi) - dr.gradient(beta - h * e, n, lam, lpi)) / (2 * h) for e in np.eye(4)]
    assert np.allclose(dr.hessian(beta, n, lam, lpi), hes, rtol=1e-3, atol=1e-3)
    assert np.allclose(dr.hessian(beta, n, lam, lpi) @ dr.inverse_hessian(beta, n, lam, lpi), np.eye(4), atol=1e-8)
    assert np.isclose(dr.log_det(beta, n, lam, lpi), np.linalg.slogdet(dr.hessian(beta, n, lam, lpi))[1])


def test_dirichlet_mode_has_no_slope():
    rng = np.random.default_rng(1)
    x = rng.dirichlet([8, 3, 5], size=50)
    lam, lpi = np.full(3, 0.01), np.log(x).sum(0)
    beta, value, _ = dr.laplace(np.log(20 * x.mean(0))[None], np.array([50.0]), lam, lpi[None])
    assert np.abs(dr.gradient(beta[0], 50.0, lam, lpi)).max() < 1e-2
    assert np.isfinite(value[0])


def test_glm_score_is_zero_and_merging_fits():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = rng.poisson(np.exp(x @ [0.5, -0.3]))
    f = glm.fit(x, y.astype(float))
    assert np.abs(x.T @ (y - np.exp(x @ f.beta)) - 0.01 * f.beta).max() < 1e-4
    g = glm.fit(x[:200], y[:200].astype(float))
    h = glm.fit(x[200:], y[200:].astype(float))
    assert np.isfinite(glm.merge_change(g, h, 0.01)) and np.isfinite(glm.laplace_evidence(x, y.astype(float), f))
    with pytest.raises(ValueError):
        glm.fit(x, y, family="normal")


def test_links(spark):
    row = spark.range(1).select(*[inv(link(F.lit(0.3))).alias(n) for n, (link, inv, _) in glm.LINKS.items()], glm.probit(F.lit(0.975)).alias("p")).first()
    assert all(abs(row[n] - 0.3) < 1e-12 for n in glm.LINKS) and abs(row["p"] - 1.959964) < 1e-5
