"""Rank-l samplers against dense ones, held-out choices, and rows with nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.functions import linalg
from sparkslab.operators import affinity, copula, suffstats
from sparkslab.plans import em, gibbs, validate
from sparkslab.plans.estimator import SlabClassifier, SlabRegressor


def test_woodbury_draws_have_the_dense_law():
    rng = np.random.default_rng(1)
    s, diag, c = rng.normal(size=(3, 6)), rng.uniform(0.2, 2, 6), rng.normal(size=6)
    dense = linalg.exact_draw(s.T @ s, diag, c, np.random.default_rng(2))[0]
    draws = np.array([linalg.woodbury_draw(s, diag, c, rng)[1] for _ in range(30_000)])
    cov = np.linalg.inv(s.T @ s + np.diag(1 / diag))
    assert np.allclose(linalg.woodbury_draw(s, diag, c, rng)[0], dense)
    assert np.abs(draws.mean(0) - dense).max() < 0.03 and np.abs(np.cov(draws.T) - cov).max() < 0.04


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(400, 3))
    x = f @ rng.normal(size=(3, 8)) + rng.normal(size=(400, 8)) * 0.05
    eta = f[:, 0] - 0.5
    y = eta + rng.normal(size=400) * 0.3
    rows = [(i, float(y[i]), float(rng.random() < 1 / (1 + np.exp(-2 * eta[i]))), float(rng.poisson(np.exp(0.5 * eta[i]))), [float(v) for v in x[i]]) for i in range(400)]
    return spark.createDataFrame(rows, "row_id long, y double, label double, n double, x array<double>").repartition(3).persist()


def test_gaussian_rank(wide):
    m = suffstats.moments(wide)
    v = suffstats.right_vectors(m, 4)
    low = suffstats.Moments(m.n, suffstats.truncate(m, 4)[0].gram, v @ (v.T @ m.xty), m.yty)
    how = {"n_samples": 3000, "burn_in": 300, "seed": 5}
    a, b = gibbs.gibbs_gaussian(m, np.zeros(8), rank=4, **how), gibbs.gibbs_gaussian(low, np.zeros(8), **how)
    assert np.abs(a.beta.mean(0) - b.beta.mean(0)).max() < 0.1 * b.beta.std(0).max() + 0.01
    assert np.allclose(a.beta.std(0), b.beta.std(0), rtol=0.15) and np.abs(a.pi - b.pi).max() < 0.08
    r = np.corrcoef(np.random.default_rng(6).normal(size=(50, 2)) @ np.random.default_rng(7).normal(size=(2, 5)), rowvar=False)
    bhat = r[0] * 0.5
    full, kept = (gibbs.gibbs_sumstats(r, bhat, 500, np.zeros(5), rank=k, n_samples=2000, burn_in=200, seed=8) for k in (None, "auto"))
    assert np.abs(full.beta.mean(0) - kept.beta.mean(0)).max() < 0.05


def test_glm_rank_sends_small_sums(wide):
    rows = wide.select(F.col("label").alias("y"), "x", F.lit(0.0).alias("off"))
    v = suffstats.right_vectors(suffstats.moments(rows), 4)
    gram, c = gibbs._augmented(rows, np.zeros(9), "bernoulli", 1.0, 9, v)
    dense, dense_c = gibbs._augmented(rows, np.zeros(9), "bernoulli", 1.0, 9)
    assert gram.shape == (4, 4) and np.allclose(v.T @ dense @ v, gram) and np.allclose(v.T @ dense_c, c)
    a = gibbs.gibbs_glm(rows, np.zeros(8), rank=4, n_samples=30, burn_in=10, seed=2)
    b = gibbs.gibbs_glm(rows, np.zeros(8), n_samples=30, burn_in=10, seed=2)
    x = np.column_stack([np.ones(400), np.stack([r.x for r in wide.collect()])])
    assert np.corrcoef(x @ a.beta.mean(0), x @ b.beta.mean(0))[0, 1] > 0.97
    n = gibbs.gibbs_glm(wide.select(F.col("n").alias("y"), "x", F.lit(None).cast("double").alias("off")), np.zeros(8), "negbin", rank=4, n_samples=4, burn_in=2)
    assert n.beta.shape == (4, 9) and np.isfinite(n.beta).all() and (n.r > 0).all()
    assert SlabRegressor(fit_method="gibbs", rank=4, n_samples=50, burn_in=10).fit(wide).draws_.beta.shape == (50, 9)


def test_nulls_in_sums_and_predictions(spark, wide):
    odd = spark.createDataFrame([(1001, None, 1.0, 1.0, [0.0] * 8), (1002, 1.0, None, None, None), (None, 1.0, 1.0, 1.0, [1.0] * 8)], wide.schema)
    more = wide.unionByName(odd)
    draws = gibbs.gibbs_glm(more.select(F.col("label").alias("y"), "x", F.lit(0.0).alias("off")).where("x is null or y is not null"), np.zeros(8), n_samples=2, burn_in=1)
    assert np.isfinite(draws.beta).all()
    assert np.isfinite(em.negbin_r(more.select(F.col("n").alias("y"), "x", F.lit(0.0).alias("off")), np.zeros(9)))
    fit = lambda m: em.em_gaussian(m, np.zeros(8)).beta
    a, b = (validate.bootstrap_ci(df, fit, n_boot=5) for df in (wide, more))
    assert np.allclose(a["lo"], b["lo"])
    bad = spark.createDataFrame([(1, [None] + [0.0] * 7), (2, None), (3, [0.0] * 8)], "row_id long, x array<double>")
    for link in ("identity", "logit", "log"):
        got = {r.row_id: r for r in validate.predict_interval(bad, np.zeros(9), np.eye(9), link).collect()}
        assert all(got[i][c] is None for i in (1, 2) for c in ("mean", "std", "lower", "upper")) and got[3].std is not None


def test_copula_of_nulls_and_clashes(spark):
    rng = np.random.default_rng(3)
    train = spark.createDataFrame([(float(v), "u", 1, 2) for v in rng.normal(size=50)], "v double, u string, a int, b int")
    new = spark.createDataFrame([(None, 7, 8, 9, 1.0), (0.1, 7, 8, 9, 1.0)], "v double, u int, a int, b int, x double")
    got = copula.to_gaussian(new.withColumn("z", F.lit(5)), train).orderBy("v").collect()
    assert got[0].z is None and abs(got[1].z) < 3 and (got[1].u, got[1].a, got[1].b) == (7, 8, 9)
    back = copula.from_gaussian(copula.to_gaussian(new, train), train).orderBy("v").collect()
    assert back[0].x is None and abs(back[1].x - 0.1) < 0.1 and list(back[1].asDict()).count("x") == 1
    assert copula.to_gaussian_empirical(new.withColumn("z", F.lit(5))).columns.count("z") == 1
    counts = spark.createDataFrame([(None, 0.5), (1.5, 0.5), (-1.0, 0.5), (2.0, 0.5)], "v double, j double")
    z = {r.v: r.z for r in copula.parametric_scores(counts, "poisson", {"mu": 2.0}, jitter="j").collect()}
    assert z[None] is None and z[1.5] is None and z[-1.0] is None and abs(z[2.0]) < 1
    with pytest.raises(ValueError, match="no value"):
        copula.fit_parametric(train.limit(0), "norm")


def test_causal_relevance_equals_the_pairs(spark):
    rng = np.random.default_rng(5)
    for scale in (1.0, 500.0, 0.01):  # some pieces, one piece, many
        f = spark.createDataFrame([(i, float(t), 1) for i, t in enumerate(np.round(rng.uniform(-2000, 2000, 300)))] + [(900, None, 1)], "feature_id long, t double, r int").repartition(3)
        g = spark.createDataFrame([(i, float(t), None if i % 9 == 0 else float(rng.uniform(0, 3)), 1) for i, t in enumerate(np.round(rng.uniform(-2000, 2000, 200)))] + [(901, None, 1.0, 1)], "group_id long, r double, relevance double, t int").repartition(2)
        for normalize in (True, False):
            a = {r.feature_id: r.wr for r in affinity.causal_relevance(f, g, scale, normalize).collect()}
            b = {r.feature_id: r.wr for r in affinity.contract(f, affinity.causal_affinity(f.drop("r"), g.drop("t"), scale), g, normalize).collect()}
            assert a.keys() == b.keys() and len(a) == 301
            assert all(abs(a[k] - b[k]) < 1e-9 * max(1, abs(b[k])) for k in b)
    assert affinity.causal_relevance(f, g.limit(0), 1.0).agg(F.sum("wr")).first()[0] == 0
    assert affinity.causal_relevance(f.limit(0), g, 1.0).count() == 0


def test_extents_with_clashing_columns(spark):
    f = spark.createDataFrame([(0, 100.0, 1, 2, 3)], "feature_id long, s double, l int, r int, mid int")
    g = spark.createDataFrame([(0, 90.0, 95.0, 9)], "group_id long, l double, r double, s int").withColumn("relevance", F.lit(2.0))
    for prune in ("midpoint", "overlap"):
        assert affinity.extent_affinity(f, g, 10.0, prune=prune).count() == 1
    edges = spark.createDataFrame([(0, 0, 0.0)], "src long, dst long, d double")
    assert affinity.resolve_affinity("graph", f, g, edges=edges).first().wr == 1.0
    assert affinity.point_affinity(f.selectExpr("feature_id", "array(s) AS f"), g.selectExpr("group_id", "array(l) AS c"), 0.0).count() == 0


def test_held_out_choices_of_the_estimator(wide):
    m = SlabRegressor(fit_method="em_filter", cv_folds=3, tau=3.0, min_features=2).fit(wide)
    assert any(abs(h["loss"] - h["ppl"]) > 1e-6 for h in m.fit_.history)
    c = SlabClassifier(fit_method="em_filter", cv_folds=2, min_features=3, max_outer=2).fit(wide.select("row_id", F.col("label").alias("y"), "x"))
    assert any(abs(h["loss"] - h["ppl"]) > 1e-6 for h in c.fit_.history)
