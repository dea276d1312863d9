"""Marginal families against closed forms, first-order conditions and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.functions import special
from sparkslab.operators import marginals


def test_incomplete_functions():
    x = np.array([0.0, 1e-6, 0.3, 1.0, 4.0, 30.0, 700.0, np.inf])
    assert np.allclose(special.gamma_cdf(1.0, x), -np.expm1(-x), atol=1e-14)
    assert np.allclose(special.gamma_cdf(0.5, x), [math.erf(math.sqrt(v)) for v in x], atol=1e-13)
    assert np.allclose(special.gamma_cdf(3.0, x[:-1]), [1 - math.exp(-v) * (1 + v + v * v / 2) for v in x[:-1]], atol=1e-13)
    u = np.linspace(0, 1, 41)
    assert np.allclose(special.beta_cdf(2.0, 3.0, u), 6 * u**2 - 8 * u**3 + 3 * u**4, atol=1e-14)
    assert np.allclose(special.beta_cdf(0.5, 0.5, u), 2 / math.pi * np.arcsin(np.sqrt(u)), atol=1e-12)
    assert np.isnan(special.gamma_cdf(2.0, np.array([np.nan]))).all()
    e = np.linspace(-30, 30, 31)
    assert np.allclose(marginals.cdf(e, "t", {"df": 1.0, "loc": 0.0, "scale": 1.0}), 0.5 + np.arctan(e) / math.pi, atol=1e-12)


CASES = {
    "gamma": ({"shape": 2.3, "scale": 0.7}, lambda r, n: r.gamma(2.3, 0.7, n)),
    "weibull": ({"shape": 1.6, "scale": 3.0}, lambda r, n: 3.0 * r.weibull(1.6, n)),
    "beta": ({"a": 0.8, "b": 2.5}, lambda r, n: r.beta(0.8, 2.5, n)),
    "t": ({"df": 4.0, "loc": 50.0, "scale": 2.0}, lambda r, n: 50 + 2 * r.standard_t(4, n)),
}


@pytest.mark.parametrize("family", CASES)
def test_fit_and_round_trip(spark, family):
    truth, draw = CASES[family]
    x = draw(np.random.default_rng(1), 4000)
    df = spark.createDataFrame([(float(v), 1.0) for v in x] + [(None, 1.0), (float("nan"), 1.0)], "v double, z double").repartition(3)
    p = marginals.fit_marginal(df, family)
    assert all(abs(p[k] / truth[k] - 1) < (0.25 if k == "df" else 0.08) for k in truth)

    def loglik(q):
        return df.where("v is not null and not isnan(v)").agg(F.avg(marginals.log_density(F.col("v"), family, q))).first()[0]

    best = loglik(p)
    for k in p:  # no neighbour is better, to 1e-4 of a parameter
        for t in (1 - 1e-4, 1 + 1e-4):
            assert loglik(p | {k: p[k] * t}) < best + 1e-13
    if family == "gamma":  # the likelihood equations
        assert abs(p["shape"] * p["scale"] - x.mean()) < 1e-6 * x.mean()
    scored = marginals.marginal_scores(df, family, p)
    assert scored.columns == ["v", "z"] and scored.where("v is null or isnan(v)").where("z is not null").count() == 0
    z = np.array([r.z for r in scored.where("z is not null").collect()])
    assert len(z) == 4000 and abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.06
    back = marginals.marginal_values(scored, family, p).where("z is not null and abs(z) < 4").collect()
    assert max(abs(r.x - r.v) / max(abs(r.v), 1e-3) for r in back) < 1e-6


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "v double")
    for df, why in ((empty, "no value"), (spark.createDataFrame([(-1.0,), (None,)], "v double"), "no value"), (spark.createDataFrame([(2.0,), (2.0,)], "v double"), "differ")):
        with pytest.raises(ValueError, match=why):
            marginals.fit_marginal(df, "gamma")
    with pytest.raises(ValueError, match="family"):
        marginals.fit_marginal(empty, "nosuch")
    p = {"shape": 1.0, "scale": 1.0}
    out = {r.v: r.z for r in marginals.marginal_scores(spark.createDataFrame([(-1.0,), (0.0,), (1e9,)], "v double"), "gamma", p).collect()}
    assert out[-1.0] == out[0.0] < -4 and out[1e9] > 4
