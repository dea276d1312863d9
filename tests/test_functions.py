"""Expressions, linear algebra and samplers against closed forms."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.functions import exprs, linalg


def test_normal_functions(spark):
    xs = [-38.0, -8.5, -3.0, -0.5, 0.0, 0.3, 2.0, 7.5, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(exprs.ndtr(F.col("x")).alias("p"), exprs.ndtri(exprs.ndtr(F.col("x"))).alias("z"), F.expr(exprs.ndtr_sql("x")).alias("s")).collect()
    for x, r in zip(xs, got, strict=True):
        want = 0.5 * math.erfc(-x / math.sqrt(2))
        assert abs(r.p - want) < 1e-15 and abs(r.s - want) < 1e-15
    us = [1e-9, 1e-3, 0.2, 0.5, 0.9, 1 - 1e-6]
    z = spark.createDataFrame([(u,) for u in us], "u double").select(exprs.ndtri(F.col("u")).alias("z"), F.expr(exprs.ndtri_sql("u")).alias("s")).collect()
    for u, r in zip(us, z, strict=True):
        assert abs(r.z - NormalDist().inv_cdf(u)) < 1e-12 and abs(r.s - r.z) < 1e-12


def test_lgamma_cosine_xi(spark):
    r = spark.range(1).select(exprs.lgamma(F.lit(7.3)).alias("g"), exprs.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), exprs.softplus(F.lit(-800.0)).alias("s")).first()
    assert abs(r.g - math.lgamma(7.3)) < 1e-12 and abs(r.c - math.sqrt(0.5)) < 1e-9 and r.s == 0.0
    upper, top = exprs.xi_bounds(50.0, 1.0)
    assert abs(upper(0.0) - top) < 1e-12


def test_woodbury_is_exact_at_full_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    r = np.corrcoef(x.T)
    s, v, d = linalg.EigenSurrogate(r, 6), rng.normal(size=6), rng.random(6) + 0.5
    want = np.linalg.solve(3.0 * r + np.diag(1 / d), v)
    assert np.allclose(linalg.woodbury_solve(s.factor(3.0, 1.0), d, v), want)
    assert s.relative_error() < 1e-12 and linalg.effective_rank(np.ones((4, 4))) == 1


def test_polya_gamma_mean():
    rng = np.random.default_rng(0)
    w = linalg.polya_gamma(np.full(20000, 1.0), np.full(20000, 2.0), rng)
    assert abs(w.mean() - math.tanh(1.0) / 4) < 0.003


def test_lyapunov_and_minimum():
    a, q = np.array([[0.5, 0.1], [0.0, 0.8]]), np.diag([1.0, 2.0])
    p = linalg.solve_lyapunov(a, q)
    assert np.allclose(p, a @ p @ a.T + q)
    assert abs(linalg.minimize(lambda x: (x - 1.3) ** 2, -5, 5) - 1.3) < 1e-4


@pytest.mark.parametrize("b", [0.3, 0.7, 1.0, 2.0, 2.5, 7.0, 13.2, 40.0, 200.0])
def test_polya_gamma_moments(b):
    n = 60_000
    for c in (0.0, 0.4, 3.0, 12.0, 90.0):
        w = linalg.polya_gamma(np.full(n, b), np.full(n, c), np.random.default_rng(int(10 * b + c)))
        mean = b / 4 if c == 0 else b * math.tanh(c / 2) / (2 * c)
        var = b / 24 if c == 0 else b * (math.tanh(c / 2) / (2 * c**3) - 1 / (4 * c**2 * math.cosh(c / 2) ** 2))
        assert w.min() > 0 and abs(w.mean() - mean) < 5 * math.sqrt(var / n), (b, c)
        spread = np.mean((w - w.mean()) ** 4) / w.var() ** 2 - 1  # of the sample variance, by the fourth moment
        assert abs(w.var() / var - 1) < 6 * math.sqrt(spread / n), (b, c)


def test_polya_gamma_exact_and_series_have_one_law():
    rng, n = np.random.default_rng(3), 40_000
    for c in (0.0, 1.5, 8.0):
        exact = np.sort(linalg.polya_gamma_one(np.full(n, c), rng))
        series = np.sort(linalg._polya_gamma_series(np.ones(n), np.full(n, c), rng, 200))
        both = np.concatenate([exact, series])
        gap = np.abs(np.searchsorted(exact, both, side="right") - np.searchsorted(series, both, side="right")).max() / n
        assert gap < 1.95 * math.sqrt(2 / n)  # Kolmogorov and Smirnov, one in a thousand


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,), (0.5,)], "x double")
    row = df.where("x is null").select(exprs.held(F.col("x"), 0.0, 1.0).alias("a"), exprs.softplus(F.col("x")).alias("b"), exprs.clipped_exp(F.col("x")).alias("c"), exprs.binomial_loglik(F.lit(1.0), 2.0, F.col("x")).alias("d"), exprs.theta_pmom(F.col("x"), 1.0, 1.0, 0.0, 0.0, 0.0).alias("e")).first()
    assert all(v is None for v in row)
    assert df.where("x is not null").select(exprs.held(F.col("x"), 0.7)).first()[0] == 0.7
