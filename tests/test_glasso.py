"""The graphical lasso by its optimality conditions, and its cross-validated penalty by brute force over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.operators import blocks
from sparkslab.operators.suffstats import moments
from sparkslab.plans.estimator import SlabRegressor


def sample(n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n, 1))
    return np.hstack([a + rng.normal(size=(n, 3)) * 0.8, b + rng.normal(size=(n, 3)) * 0.8])


@pytest.mark.parametrize("alpha", [0.02, 0.1, 0.4, 0.9])
def test_optimality(alpha):
    s = np.corrcoef(sample().T)
    theta, at = blocks.graphical_lasso(s, alpha, tol=1e-9, max_iter=500)
    gap = np.linalg.inv(theta) - s
    off = ~np.eye(len(s), dtype=bool)
    kept = off & (np.abs(theta) > 1e-8)
    assert np.allclose(gap[kept], alpha * np.sign(theta[kept]), atol=1e-4) and (np.abs(gap[off & ~kept]) <= alpha + 1e-6).all() and np.allclose(np.diag(gap), 0, atol=1e-6)
    warm = blocks.graphical_lasso(s, alpha, tol=1e-9, max_iter=500, start=blocks.graphical_lasso(s, 0.95)[1])[0]
    assert np.allclose(warm, theta, atol=1e-5)
    assert blocks.graphical_lasso(np.eye(1), alpha)[0].tolist() == [[1.0]]


def test_penalty_by_brute_force(spark):
    x = sample()
    rows = spark.createDataFrame([(i, 0.0, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "row_id long, y double, x array<double>, fold int").repartition(4)
    folds = moments(rows, by="fold")
    got = blocks.glasso_alpha(spark, folds)
    z = (x - x.mean(0)) / x.std(0)

    def loss(alpha):
        total = 0.0
        for k in range(3):
            held = np.arange(len(z)) % 3 == k
            theta = blocks.graphical_lasso(np.cov(z[~held].T, ddof=0), alpha)[0]
            total += np.sum(np.cov(z[held].T, ddof=0) * theta) - np.linalg.slogdet(theta)[1]
        return total

    grid = np.geomspace(0.01, 0.9, 60)
    assert loss(got) <= min(map(loss, grid)) + 1e-3
    nodes = spark.range(6).withColumnRenamed("id", "feature_id")
    r = np.corrcoef(x.T)
    by_cv = blocks.determine_blocks(nodes, "glasso", covariance=r, alpha="cv", folds=folds)
    assert by_cv.count() == 6
    linked = {(i, j) for i in range(6) for j in range(6) if abs(r[i, j]) > 0.4}  # the components need only the correlations
    b = {x.feature_id: x.block_id for x in blocks.determine_blocks(nodes, "glasso", covariance=r, alpha=0.4).collect()}
    assert b[0] == b[1] == b[2] != b[3] == b[4] == b[5] and all(b[i] == b[j] for i, j in linked)
    with pytest.raises(ValueError, match="folds"):
        blocks.determine_blocks(nodes, "glasso", covariance=r, alpha="cv")


def test_estimator_with_a_cross_validated_penalty(spark):
    x = sample()
    rows = spark.createDataFrame([(i, float(r[:3].sum()), [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, y double, x array<double>")
    places = spark.range(6).select(F.col("id").alias("feature_id"), F.col("id").cast("double").alias("s"))
    m = SlabRegressor(decorrelate="ppca", block_method="glasso", alpha="cv").fit(rows, places)
    assert len(m.blocks_) == 6 and SlabRegressor(alpha=0.3).clone().alpha == 0.3
