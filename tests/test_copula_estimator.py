"""Arrays on a sample's normal scale and estimators with copula marginals, against NumPy."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.operators import copula
from sparkslab.plans.estimator import SlabClassifier, SlabRegressor

SCHEMA = "row_id long, y double, x array<double>, t long, _z string"


def brute(train, v):
    """Normal score of v: linear between the Hazen ranks of the sorted sample; ties take their highest."""
    s = np.sort(train)
    u = (np.arange(1, len(s) + 1) - 0.5) / len(s)
    hit = np.flatnonzero(s == v)
    at = u[hit[-1]] if len(hit) else np.interp(v, s, u)
    return NormalDist().inv_cdf(min(max(at, 1e-6), 1 - 1e-6))


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(240, 2))
    x = np.column_stack([np.exp(base[:, 0] + 0.3 * r.normal(size=240)), np.round(base[:, 0] * 2 + r.normal(size=240) * 0.3), base[:, 1] ** 3, base[:, 1] + 0.2 * r.normal(size=240)])
    y = 2 * base[:, 0] + 0.3 * r.normal(size=240)
    return x, y, spark.createDataFrame([(i, float(y[i]), x[i].tolist(), i, "keep") for i in range(240)], SCHEMA)


@pytest.mark.parametrize("few", [1_000_000, 100])
def test_wide_scores(spark, data, monkeypatch, few):
    """Both by searched and by swept knots."""
    monkeypatch.setattr(copula, "BROADCAST_KNOTS", few)
    x, _, rows = data
    train, n = x[:160], float("nan")
    new = [(1, 0.0, x[200].tolist(), 0, "a"), (1, 0.0, x[200].tolist(), 0, "a"), (None, None, [1e9, -1e9, None, n], None, None), (3, 0.0, None, 0, "b"), (4, 0.0, [], 0, "c"), (5, 0.0, [1.0, 0.0], 0, "d"), (6, 0.0, [0.5, 0.0, 0.0, 0.0, 7.0], 0, "e")]
    got = copula.wide_scores(spark.createDataFrame(new, SCHEMA), copula.wide_ecdf(rows.where("row_id < 160")))
    assert got.columns == ["row_id", "y", "x", "t", "_z"]
    by = {r._z: r for r in got.collect()}
    assert got.count() == 7 and got.where("_z = 'a'").count() == 2
    assert np.allclose(by["a"].x, [brute(train[:, j], x[200, j]) for j in range(4)], atol=1e-6)
    ends = by[None].x
    assert abs(ends[0] - NormalDist().inv_cdf(1 - 0.5 / 160)) < 1e-6 and ends[2:] == [None, None] and ends[1] < -2
    assert by["b"].x is None and by["c"].x == [] and len(by["d"].x) == 2 and by["e"].x[4] is None
    none = copula.wide_scores(rows.limit(0), copula.wide_ecdf(rows))
    assert none.count() == 0
    assert copula.wide_scores(rows, copula.wide_ecdf(rows.limit(0))).where(F.exists("x", lambda v: v.isNotNull())).count() == 0


@pytest.mark.parametrize("kind", ["ppca", "ar1"])
def test_estimator_by_scores(spark, data, tmp_path, kind):
    """The fit with the option is the fit without it on features that NumPy has ranked."""
    x, y, rows = data
    old, new = rows.where("row_id < 160"), rows.where("row_id >= 160")
    places = spark.range(4).select(F.col("id").alias("feature_id"), F.col("id").cast("double").alias("s"))
    ids = np.array([0, 0, 1, 1])
    z = np.array([[brute(x[:160, j], v) for j, v in enumerate(row)] for row in x])
    ranked = spark.createDataFrame([(i, float(y[i]), z[i].tolist(), i, "") for i in range(240)], SCHEMA)
    model = SlabRegressor(decorrelate=kind, xi0=0.0, kappa=50.0, marginal="copula").fit(old, places, block_id=ids)
    plain = SlabRegressor(decorrelate=kind, xi0=0.0, kappa=50.0).fit(ranked.where("row_id < 160"), places, block_id=ids)
    assert np.allclose(model.fit_.beta, plain.fit_.beta, atol=1e-4) and np.allclose(model.cov_, plain.cov_, atol=1e-4)
    means = lambda m, r: [p["mean"] for p in m.predict(r).orderBy("row_id").collect()]
    want = means(plain, ranked.where("row_id >= 160"))
    assert np.allclose(means(model, new), want, atol=1e-3)
    model.save(spark, str(tmp_path / kind))
    again = SlabRegressor.load(spark, str(tmp_path / kind))
    assert again.marginal == "copula" and np.allclose(means(again, new), want, atol=1e-3)
    assert "marginal copula" in model.summary() and model.clone().marginal == "copula"
    with pytest.raises(ValueError, match="marginal"):
        model.bootstrap_ci(old, 5)


def test_refused(spark, data):
    rows = data[2]
    places = spark.range(4).select(F.col("id").alias("feature_id"), F.col("id").cast("double").alias("s"))
    with pytest.raises(ValueError, match="unknown marginal"):
        SlabRegressor(decorrelate="ppca", marginal="cauchy").fit(rows, places)
    with pytest.raises(ValueError, match="decorrelated"):
        SlabRegressor(marginal="copula").fit(rows)
    with pytest.raises(ValueError, match="decorrelated"):
        SlabClassifier(decorrelate="binomial_sar", marginal="copula").fit(rows, places)


def test_scores_by_cells_are_the_searched_ones(spark, data, monkeypatch):
    """Many cells, of which a hot value's and the nulls' are several tasks' work, and batches that end inside an array."""
    monkeypatch.setattr(copula, "CELL", 12)
    monkeypatch.setattr(copula, "PART", 9)
    x, _, rows = data
    hot = [(1000 + k, 0.0, [0.5, 1.0, None, float(k)], k, "hot") for k in range(60)]
    both = rows.union(spark.createDataFrame(hot, SCHEMA))
    knots = copula.wide_ecdf(both.where("row_id % 3 > 0"))
    train = [(j, v) for i, r in enumerate(x) if i % 3 for j, v in enumerate(r)] + [(j, v) for i, _, r, _, _ in hot if i % 3 for j, v in enumerate(r) if v is not None]
    got = {(r.feature_id, r.v): (r.u_low, r.u_high) for r in knots.collect()}
    assert set(got) == set(train)
    for j in range(4):
        s = np.sort([v for k, v in train if k == j])
        for v in np.unique(s):
            low, high = np.searchsorted(s, v), np.searchsorted(s, v, "right")
            assert got[j, v] == ((low + 0.5) / len(s), (high - 0.5) / len(s))
    want = {r.row_id: r.x for r in copula.wide_scores(both, knots).collect()}
    monkeypatch.setattr(copula, "BROADCAST_KNOTS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.row_id: r.x for r in copula.wide_scores(both, knots).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == want and len(found) == 300
