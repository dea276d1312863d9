"""Copula marginals of continuous families, fitted by Newton's method on the rows' likelihood, with their scores and inverses.

A pass sums the log-likelihood, by native expressions, at the points around the
current parameters that second differences need: score and Hessian come from
one aggregate whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkslab.functions import special
from sparkslab.functions.exprs import held, ndtri
from sparkslab.functions.linalg import normal_cdf
from sparkslab.operators.copula import EPS


@dataclass(frozen=True)
class Family:
    """Names of the parameters (those in ``positive`` are fitted by their logarithm) and the ends of the support."""

    names: tuple[str, ...]
    positive: frozenset[str]
    low: float
    high: float


FAMILIES = {
    "gamma": Family(("shape", "scale"), frozenset(("shape", "scale")), 0.0, math.inf),
    "weibull": Family(("shape", "scale"), frozenset(("shape", "scale")), 0.0, math.inf),
    "beta": Family(("a", "b"), frozenset(("a", "b")), 0.0, 1.0),
    "t": Family(("df", "loc", "scale"), frozenset(("df", "scale")), -math.inf, math.inf),
}


def log_density(x: Column, family: str, p: dict[str, float]) -> Column:
    """Of values inside the support."""
    if family == "gamma":
        return (p["shape"] - 1) * F.ln(x) - x / p["scale"] - (p["shape"] * math.log(p["scale"]) + math.lgamma(p["shape"]))
    if family == "weibull":
        r = F.ln(x) - math.log(p["scale"])
        return math.log(p["shape"] / p["scale"]) + (p["shape"] - 1) * r - F.exp(p["shape"] * r)
    if family == "beta":
        return (p["a"] - 1) * F.ln(x) + (p["b"] - 1) * F.log1p(-x) + (math.lgamma(p["a"] + p["b"]) - math.lgamma(p["a"]) - math.lgamma(p["b"]))
    e = (x - p["loc"]) / p["scale"]
    constant = math.lgamma((p["df"] + 1) / 2) - math.lgamma(p["df"] / 2) - 0.5 * math.log(p["df"] * math.pi) - math.log(p["scale"])
    return constant - (p["df"] + 1) / 2 * F.log1p(e * e / p["df"])


def cdf(x: np.ndarray, family: str, p: dict[str, float]) -> np.ndarray:
    """Distribution function, of values anywhere."""
    x = np.asarray(x, float)
    if family == "gamma":
        return special.gamma_cdf(p["shape"], x / p["scale"])
    if family == "weibull":
        return -np.expm1(-((np.maximum(x, 0) / p["scale"]) ** p["shape"]))
    if family == "beta":
        return special.beta_cdf(p["a"], p["b"], x)
    e = (x - p["loc"]) / p["scale"]
    tail = 0.5 * special.beta_cdf(p["df"] / 2, 0.5, p["df"] / (p["df"] + e * e))
    return np.where(e > 0, 1 - tail, tail)


def _start(family: str, m: float, s2: float, lm: float, ls2: float) -> dict[str, float]:
    """From mean, variance, and those of the logarithm."""
    s2 = max(s2, 1e-12)
    if family == "gamma":
        return {"shape": max(m * m / s2, 1e-2), "scale": s2 / m}
    if family == "weibull":
        shape = math.pi / math.sqrt(6 * max(ls2, 1e-12))
        return {"shape": shape, "scale": math.exp(lm + 0.5772156649015329 / shape)}
    if family == "beta":
        k = max(m * (1 - m) / s2 - 1, 1e-2)
        return {"a": m * k, "b": (1 - m) * k}
    return {"df": 5.0, "loc": m, "scale": math.sqrt(0.6 * s2)}


def fit_marginal(df: DataFrame, family: str, value: str = "v", max_iter: int = 60, tol: float = 1e-9) -> dict[str, float]:
    """Maximum-likelihood parameters of gamma, weibull, beta or t, from the values inside the support; a table without any raises ValueError.

    Each iteration is one pass; a step that doesn't gain is halved, with the
    next pass.  A t distribution's df is held within 1e-2..1e6.
    """
    if family not in FAMILIES:
        raise ValueError(f"no marginal family {family!r}")
    f = FAMILIES[family]
    v = F.col(value).cast("double")
    x = df.select(v.alias("x")).where((F.col("x") > f.low) & (F.col("x") < f.high) & ~F.isnan("x"))
    log = F.ln("x") if f.low == 0 else F.lit(0.0)
    s = x.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s2"), F.avg(log).alias("lm"), F.var_pop(log).alias("ls2")).first()
    if not s.n:
        raise ValueError("no value to fit a marginal to")
    if not s.s2 > 0:
        raise ValueError("a marginal needs values that differ")
    begin = _start(family, s.m, s.s2, s.lm, s.ls2)
    unit = {"loc": math.sqrt(s.s2)}
    k = len(f.names)

    def given(theta: np.ndarray) -> dict[str, float]:
        p = {n: float(math.exp(min(max(t, -600.0), 600.0))) if n in f.positive else float(t * unit[n]) for n, t in zip(f.names, theta, strict=True)}
        return p | ({"df": min(max(p["df"], 1e-2), 1e6)} if family == "t" else {})

    def around(theta: np.ndarray, h: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
        e = np.eye(k) * h
        points = [theta, *[theta + i for i in e], *[theta - i for i in e], *[theta + a * e[i] + b * e[j] for i in range(k) for j in range(i) for a in (1, -1) for b in (1, -1)]]
        one = x.agg(*[F.avg(log_density(F.col("x"), family, given(p))).alias(f"l{i}") for i, p in enumerate(points)]).first()
        at, up, down = one[0], np.array(one[1 : k + 1]), np.array(one[k + 1 : 2 * k + 1])
        hess, rest = np.diag((up - 2 * at + down) / h**2), iter(one[2 * k + 1 :])
        for i in range(k):
            for j in range(i):
                hess[i, j] = hess[j, i] = (next(rest) - next(rest) - next(rest) + next(rest)) / (4 * h * h)
        return at, (up - down) / (2 * h), hess

    theta = np.array([math.log(begin[n]) if n in f.positive else begin[n] / unit[n] for n in f.names])
    at, score, hess = around(theta)
    for _ in range(max_iter):
        e, u = np.linalg.eigh(-hess)
        step = u @ ((u.T @ score) / np.maximum(np.abs(e), 1e-6))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        gained = False
        for _ in range(20):
            new = around(theta + step)
            if new[0] >= at - 1e-14 * abs(at):
                gained = True
                break
            step = step / 2
        if not gained:
            break
        theta, (at, score, hess) = theta + step, new
        if np.abs(step).max() < tol:
            break
    return given(theta)


def marginal_scores(df: DataFrame, family: str, p: dict[str, float], value: str = "v") -> DataFrame:
    """``df`` with z (replaced if there is one): normal scores under fitted parameters; a null or nan has none.

    A value outside the support has the score of its end.
    """
    return _through(df, value, "_u", lambda x: cdf(x, family, p)).withColumn("z", ndtri(held(F.col("_u"), EPS, 1 - EPS))).drop("_u")


def marginal_values(df: DataFrame, family: str, p: dict[str, float], z: str = "z") -> DataFrame:
    """``df`` with x (replaced if there is one): normal scores back on the family's scale."""
    f = FAMILIES[family]
    back = _through(df, z, "_x", lambda v: special.inverse(lambda x: cdf(x, family, p), np.clip(normal_cdf(v), EPS, 1 - EPS), f.low, f.high))
    return back.drop("x").withColumnRenamed("_x", "x")


def _through(df: DataFrame, column: str, name: str, g) -> DataFrame:
    """``df`` with g of a column, through Arrow batches; null where it is null or nan."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = part.to_numpy(float)
            out = g(x) if len(x) else x
            yield pd.Series(out).where(~np.isnan(x) & ~np.isnan(out), None)

    return df.withColumn(name, F.pandas_udf(run, "double")(F.col(column).cast("double")))
