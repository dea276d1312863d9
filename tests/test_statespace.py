"""The scan over buckets of time against the sequential filter, smoother and EM; estimators on long trajectories."""

import numpy as np
import pytest

from sparkslab.plans import dynamic, estimator, statespace
from sparkslab.plans.estimator import SlabRegressor

W = np.array([[0, 0.5, 0], [0.5, 0, 0.5], [0, 0.5, 0]])
OWNER = np.repeat(np.arange(3), 2)


def coupled(n, seed=1):
    rng = np.random.default_rng(seed)
    z, step = np.zeros((n, 3)), 0.5 * np.eye(3) + 0.3 * W
    for t in range(1, n):
        z[t] = step @ z[t - 1] + rng.normal(size=3) * 0.5
    return z, z[:, OWNER] * 1.1 + rng.normal(size=(n, 6)) * 0.6


def frame(spark, x, t=None):
    t = range(len(x)) if t is None else t
    return spark.createDataFrame([(i, a, [None if np.isnan(v) else float(v) for v in r]) for i, (a, r) in enumerate(zip(t, x, strict=True))], "row_id long, t long, x array<double>").repartition(3)


@pytest.mark.parametrize("smooth", [False, True])
@pytest.mark.parametrize("kind", ["coupled", "one", "chains"])
def test_states_equal_the_sequential_filter(spark, kind, smooth):
    _, x = coupled(900)
    if kind == "coupled":
        f = dynamic.fit_dynamic(x, OWNER, W, n_iter=5)
    elif kind == "one":
        x = x[:, :2]
        f = dynamic.fit_dynamic(x, n_iter=5)
    else:
        f = statespace.joined([dynamic.fit_dynamic(x[:, OWNER == b], n_iter=5) for b in range(3)], [np.flatnonzero(OWNER == b) for b in range(3)])
    x[::7, 1], x[5], x[400:420] = np.nan, np.nan, np.nan
    want = dynamic.filter_dynamic(x, f, smooth=smooth)
    for size in (10_000, 70):
        got = statespace.states(frame(spark, x), f, smooth=smooth, per_bucket=size).orderBy("row_id").collect()
        assert np.abs(np.array([r.z for r in got]) - want[0]).max() < 1e-8
        assert np.abs(np.array([r.z_var for r in got]) - want[1]).max() < 1e-8
    start = np.full(len(f.q), 0.7), np.eye(len(f.q)) * 0.3
    want = dynamic.filter_dynamic(x, f, smooth, *start)[0]
    got = statespace.states(frame(spark, x), f, smooth=smooth, per_bucket=70, start=start).orderBy("row_id").collect()
    assert np.abs(np.array([r.z for r in got]) - want).max() < 1e-8


def test_trajectories_ties_nulls_and_empties(spark):
    _, x = coupled(300, 2)
    f = dynamic.fit_dynamic(x[:, :2], n_iter=5)
    rows = frame(spark, x[:, :2]).selectExpr("row_id", "if(row_id % 50 = 0, null, t div 2) AS t", "if(row_id = 7, null, x) AS x", "if(row_id % 3 = 0, null, row_id % 3) AS z", "1 AS p")
    got = statespace.states(rows, f, by=["z"], keep=["row_id", "p"], per_bucket=20)
    again = statespace.states(rows.repartition(7), f, by=["z"], keep=["row_id", "p"], per_bucket=1000)
    a, b = ({r.row_id: r.z[0] for r in df.collect()} for df in (got, again))
    assert got.columns == ["row_id", "p", "z", "z_var"] and len(a) == 300 and max(abs(a[k] - b[k]) for k in b) < 1e-10
    assert statespace.states(rows.limit(0), f, by=["z"], keep=["row_id"]).collect() == []


def test_em_equals_the_sequential_fit(spark):
    _, x = coupled(800, 3)
    for owner, w in ((OWNER, W), (OWNER, None)):
        got = statespace.fit_states(frame(spark, x), owner, w, per_bucket=300, n_iter=6)
        want = [dynamic.fit_dynamic(x, owner, w, n_iter=6)] if w is not None else [dynamic.fit_dynamic(x[:, owner == b], n_iter=6) for b in range(3)]
        for a, b in zip(got, want, strict=True):
            for name in ("loadings", "noise", "phi", "q", "mean", "rho"):
                assert np.allclose(getattr(a, name), getattr(b, name), rtol=1e-8, atol=1e-10), name
        if w is not None:
            assert np.allclose(got[0].loglik, want[0].loglik) and (np.diff(got[0].loglik) > -1e-6).all()


@pytest.mark.parametrize("kind", ["ar1", "star"])
def test_estimator_on_a_long_trajectory(spark, kind, monkeypatch, tmp_path):
    z, x = coupled(500, 4)
    y = 1.5 * z[:, 0] - z[:, 2] + np.random.default_rng(5).normal(size=500) * 0.2
    rows = spark.createDataFrame([(i, float(y[i]), [float(v) for v in x[i]], i) for i in range(500)], "row_id long, y double, x array<double>, t long")
    places = spark.createDataFrame([(j, float(OWNER[j] * 10 + j % 2)) for j in range(6)], "feature_id long, s double")
    monkeypatch.setattr(dynamic.fit_dynamic, "__defaults__", (None, None, 3, 1e-4, (0.5, 0.0)))
    short = SlabRegressor(decorrelate=kind, xi0=-1).fit(rows, places, block_id=OWNER)
    monkeypatch.setattr(estimator, "GATHERED", 100)
    monkeypatch.setattr(statespace.states, "__defaults__", (None, "t", None, False, 150, None))
    monkeypatch.setattr(statespace.fit_states, "__defaults__", (None, "t", 3, 1e-4, (0.5, 0.0), 250))
    long = SlabRegressor(decorrelate=kind, xi0=-1).fit(rows, places, block_id=OWNER)
    assert np.allclose(short.fit_.beta, long.fit_.beta, rtol=1e-6, atol=1e-8)
    with pytest.raises(ValueError, match="pass its rows"):
        long.plot_data(spark, "latent")
    assert long.plot_data(spark, "latent", rows).count() == 1500
    assert short.plot_data(spark, "latent").count() == 1500
    long.save(spark, f"{tmp_path}/model")
    back = SlabRegressor.load(spark, f"{tmp_path}/model")
    a, b = ({r.row_id: (r.mean, r.std) for r in m.predict(rows).collect()} for m in (long, back))
    assert max(abs(a[k][0] - b[k][0]) for k in a) < 1e-9
    fitted = long.plot_data(spark, "fitted", rows).toPandas()
    assert 1 - ((fitted.actual - fitted.fitted) ** 2).sum() / ((fitted.actual - fitted.actual.mean()) ** 2).sum() > 0.7


def test_estimator_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, y double, x array<double>")
    with pytest.raises(ValueError, match="no row"):
        SlabRegressor().fit(empty)


def test_buckets_are_found_by_ends_of_ends(spark):
    """A row's bucket is the number of ends below its time, found without a look at each of them."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 2003).alias("t"))
    made, n = statespace.dealt(rows, ["g"], "t", per_bucket=7)
    ends = {r.g: r.e for r in rows.groupBy("g").agg(F.percentile_approx("t", [k / n for k in range(1, n)], max(1_000, 16 * n)).alias("e")).collect()}
    got = made.select("g", "t", "_bucket").collect()
    assert n == 143 and len(got) == 3000
    assert all(r._bucket == (0 if r.t is None else sum(e < r.t for e in ends[r.g])) for r in got)
    assert "slice(" in made._jdf.queryExecution().optimizedPlan().toString()
