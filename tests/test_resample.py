"""Resampled fits against plain fits of the repeated rows, and intervals for every family and latent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.plans import em, resample, validate
from sparkslab.plans.estimator import SlabClassifier, SlabCountRegressor, SlabRegressor

BLOCKS = np.repeat([0, 1], 2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    z = np.zeros((160, 2))
    for t in range(1, 160):
        z[t] = 0.7 * z[t - 1] + rng.normal(size=2) * 0.7
    x = np.repeat(z, 2, axis=1) + rng.normal(size=(160, 4)) * 0.3
    eta = 0.2 + z[:, 0]
    made = [(i, float(eta[i] + rng.normal() * 0.3), float(rng.random() < 1 / (1 + np.exp(-2 * eta[i]))), float(rng.poisson(np.exp(0.6 * eta[i]))), [float(v) for v in x[i]], i) for i in range(160)]
    return spark.createDataFrame(made, "row_id long, y double, label double, n double, x array<double>, t long").repartition(3).persist()


@pytest.mark.parametrize("family", ["bernoulli", "poisson", "negbin"])
def test_resamples_by_brute_force(spark, rows, family):
    some = rows.select("row_id", F.col("label" if family == "bernoulli" else "n").alias("y"), "x", F.lit(0.0).alias("off"))
    odd = spark.createDataFrame([(None, 1.0, [0.0] * 4, 0.0), (7001, None, [0.0] * 4, 0.0), (7002, 1.0, None, 0.0)], some.schema)
    maps = [np.array([[1, 0, 0, 0, 0], [0.1, 0.5, 0.5, 0, 0], [0, 0, 0, 0.5, 0.5 + b]]) for b in range(3)]
    for use in (None, maps):
        k = 4 if use is None else 2
        got = resample.em_glm_resampled(some.unionByName(odd), np.zeros(k), family, n_boot=3, seed=4, r=5.0, maps=use)
        plain = some.collect()
        times = validate.resample_weights(np.array([r.row_id for r in plain]), 3, 4)
        for b in range(2):
            design = (lambda x, b=b: [float(v) for v in (use[b] @ np.concatenate([[1], x]))[1:]]) if use else (lambda x: x)
            shift = use[b][1:, 0] if use else 0
            assert use is None or np.allclose(design([0.0] * 4), shift)
            again = spark.createDataFrame([(r.y, design(r.x), 0.0) for r, w in zip(plain, times[:, b], strict=True) for _ in range(int(w))], "y double, x array<double>, off double").persist()
            want = em.em_glm(again, np.zeros(k), family, r=5.0, r_fixed=True).beta
            assert np.allclose(got[b], want, atol=1e-5), (family, b)


def test_moving_blocks():
    at = resample.moving_blocks(50, 7, np.random.default_rng(0))
    assert len(at) == 50 and at.min() >= 0 and at.max() < 50 and (np.diff(at) == 1).sum() >= 50 - 8
    assert resample.moving_blocks(3, 10, np.random.default_rng(0)).tolist() == [0, 1, 2]


def test_intervals_for_every_family_and_latent(spark, rows):
    places = spark.createDataFrame([(j, float(BLOCKS[j] * 10 + j % 2)) for j in range(4)], "feature_id long, s double")
    labels, counts = rows.select("row_id", F.col("label").alias("y"), "x"), rows.select("row_id", F.col("n").alias("y"), "x")
    for model, data in ((SlabClassifier(xi0=1), labels), (SlabCountRegressor("poisson", xi0=1), counts), (SlabCountRegressor("negbin", xi0=1), counts), (SlabClassifier(xi0=1, decorrelate="ppca"), labels), (SlabRegressor(xi0=1, decorrelate="ar1"), rows.select("row_id", "y", "x", "t"))):
        how = {"block_id": BLOCKS} if model.decorrelate else {}
        got = model.fit(data, places, **how).bootstrap_ci(data, n_boot=6)
        assert got["lo"].shape == model.fit_.beta.shape and (got["lo"] <= got["hi"]).all() and got["failed"] == 0
        strongest = 1 if model.decorrelate else slice(1, 3)
        assert np.sum(got["mean"][strongest]) > 0.2
    with pytest.raises(ValueError, match="EM"):
        SlabRegressor(fit_method="gibbs", n_samples=20, burn_in=5).fit(rows).bootstrap_ci(rows)
