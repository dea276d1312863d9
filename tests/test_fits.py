"""Fits: recovery, equivalences, error contracts."""

import numpy as np
import pytest

from sparkslab.operators import factor
from sparkslab.operators.suffstats import moments, right_vectors, truncate, weighted_rows
from sparkslab.plans import dynamic, em, gibbs, joint, latent, validate
from sparkslab.plans.estimator import SlabClassifier, SlabCountRegressor, SlabRegressor, predictor
from sparkslab.sources.tables import from_arrays, gaussian_data


@pytest.fixture(scope="module")
def rows(spark):
    return gaussian_data(spark, 600, 20, {3: 2.0, 10: -1.5}, intercept=0.5, seed=3).persist()


def test_gaussian_em_filter_gibbs(spark, rows):
    m, wr, prior = moments(rows), np.zeros(20), em.Prior(xi0=-1.0, kappa=50.0)
    fit = em.em_gaussian(m, wr, prior)
    assert set(np.flatnonzero(fit.theta > 0.9)) == {3, 10} and abs(fit.sigma_y2 - 1) < 0.5
    kept = em.em_filter_gaussian(m, wr, prior)
    assert {3, 10} <= set(kept.retained)
    d = gibbs.gibbs_gaussian(m, wr, prior, n_samples=300, burn_in=100, seed=0)
    assert d.pi[3] > 0.9 and d.pi[10] > 0.9
    assert em.em_gaussian(m, wr, prior, tau=50 / 3).theta[3] > 0.9


def test_sumstats_equals_raw(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, 0] - x[:, 2] + rng.normal(size=500)
    y -= y.mean()
    a = em.em_gaussian(moments(from_arrays(spark, x, y)), np.zeros(5))
    for rank in (None, 5, "auto"):
        b = em.em_sumstats(x.T @ x / 500, x.T @ y / 500, 500, np.zeros(5), y_var=y.var(), rank=rank)
        assert np.allclose(a.beta, b.beta, rtol=1e-4, atol=1e-6)


def test_full_rank_is_exact(spark, rows):
    m = moments(rows)
    low, error = truncate(m, 21)
    assert np.allclose(low.gram, m.gram) and error < 1e-6 and truncate(m, 5)[1] > 0.1
    beta, link = np.zeros(21), em.Family("bernoulli")
    step = lambda v: weighted_rows(rows, beta, lambda eta, y, off: link.step(eta, y, off, 1.0), v)
    assert np.allclose(step(None)[0], step(right_vectors(m, 21))[0])


def test_glms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4))
    eta = 0.5 + x @ [0.8, -0.6, 0.0, 0.0]
    pois = em.em_glm(from_arrays(spark, x, rng.poisson(np.exp(eta))).persist(), np.zeros(4), "poisson", em.Prior(xi0=0.0, kappa=50.0), max_iter=30)
    assert np.allclose(pois.beta, [0.5, 0.8, -0.6, 0, 0], atol=0.3)
    nb = em.em_glm(from_arrays(spark, x, rng.poisson(rng.gamma(5, np.exp(eta) / 5))).persist(), np.zeros(4), "negbin", max_iter=12)
    assert 1 < nb.r < 50
    logit = em.em_glm(from_arrays(spark, x, (rng.random(1500) < 1 / (1 + np.exp(-2 * eta))).astype(float)).persist(), np.zeros(4), "bernoulli", max_iter=20, firth=True)
    assert logit.beta[1] > 1.2 and abs(logit.beta[4]) < 0.3 and logit.theta[0] > logit.theta[3]


def test_dynamic_factors():
    rho, shape = 0.7, np.array([1.5, -0.5, 0.9, 0.7, 1.1])
    rng = np.random.default_rng(31)
    shocks = rng.normal(scale=np.sqrt(1 - rho**2), size=600)
    z = np.array([sum(rho**k * shocks[t - k] for k in range(min(t + 1, 60))) for t in range(600)])
    x = z[:, None] * shape + rng.normal(scale=0.4, size=(600, 5))
    f = dynamic.fit_dynamic(x)
    assert abs(f.rho[0] - rho) < 0.05 and abs(np.corrcoef(f.z[:, 0], z)[0, 1]) > 0.95
    assert np.allclose(f.loadings / f.loadings[0], shape / shape[0], atol=0.1)
    assert np.all(np.diff(f.loglik) > -1e-6 * np.abs(f.loglik[:-1]))
    g = dynamic.fit_dynamic(x, np.zeros(5, int), np.zeros((1, 1)))
    assert abs(g.rho[0] - f.rho[0]) < 0.02 and g.rho[1] == 0.0
    z1, _ = dynamic.filter_dynamic(x[:200], f, smooth=False)
    assert z1.shape == (200, 1)


def test_latent_and_joint(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(120, 2))
    x = rng.binomial(2, 1 / (1 + np.exp(-np.repeat(z, 3, axis=1)))).astype(float)
    y = (rng.random(120) < 1 / (1 + np.exp(-2.5 * z[:, 0]))).astype(float)
    rows, ids = from_arrays(spark, x, y), np.repeat([0, 1], 3)
    fits = latent.fit_blocks(spark, *factor.covariance(moments(rows)), np.arange(6.0), ids, steps=10)
    got = latent.infer_scores(rows, fits, ids).orderBy("row_id").collect()
    assert abs(np.corrcoef([r.z[0] for r in got], z[:, 0])[0, 1]) > 0.6
    model = joint.JointModel(x, y, ids, fits)
    q = model.start(np.random.default_rng(1)) + 0.1
    lp, g = model.value(q)
    for i in np.random.default_rng(2).choice(model.size, 25, replace=False):
        e = np.zeros(model.size)
        e[i] = 1e-5
        assert abs((model.value(q + e)[0] - model.value(q - e)[0]) / 2e-5 - g[i]) < 1e-3 * (1 + abs(g[i]))
    draws = joint.nuts(model, 60, 60).draws
    assert np.mean(np.abs(draws[:, 0])) > np.mean(np.abs(draws[:, 1]))
    with pytest.raises(ValueError):
        joint.tau0(3, 100, 3.0)


def test_estimator(spark, rows, tmp_path):
    r = SlabRegressor(xi0=-1.0, kappa=50.0).fit(rows)
    p = r.predict(rows)
    s = p.selectExpr("1 - sum(pow(y - mean, 2)) / (var_pop(y) * count(*)) AS r2").first().r2
    assert s > 0.5 and "x3" in r.summary()
    r.save(spark, str(tmp_path / "m"))
    again = SlabRegressor.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.fit_.beta, r.fit_.beta)
    with pytest.raises(TypeError):
        SlabClassifier.load(spark, str(tmp_path / "m"))
    with pytest.raises(RuntimeError):
        SlabRegressor().predict(rows)
    with pytest.raises(ValueError):
        SlabRegressor(decorrelate="ppca").fit(rows)
    with pytest.raises(ValueError):
        SlabCountRegressor(fit_method="gibbs").fit(rows)
    assert r.clone().get_params() == r.get_params()
    ci = r.bootstrap_ci(rows, 30)
    assert ci["lo"][4] < 2.0 < ci["hi"][4] + 0.2


def test_validation(spark, rows):
    folded = validate.with_folds(rows, 4)
    pred = validate.cross_val_predict(folded, validate.ridge_by_fold(moments(folded, by="fold")))
    assert all(r.score > 0.5 for r in validate.r2_by_fold(pred).collect())
    c = spark.createDataFrame([(b, b - 1.0, b + 1.0) for b in (0.0, 1.5, 0.0, -2.0)], "beta_true double, lo double, hi double")
    assert {r.grp: (r.coverage, r.n) for r in validate.coverage(c).collect()} == {"causal": (1.0, 2), "null": (1.0, 2), "overall": (1.0, 4)}
    t = spark.createDataFrame([(0.3, 1), (0.05, 0), (1.0, 1)], "theta double, is_causal int")
    assert {r.bin: r.n for r in validate.reliability(t).collect() if r.n} == {0: 1, 2: 1, 9: 1}


def test_filters_keep_what_matters(spark, rows):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 14))
    eta = 0.3 + 0.9 * x[:, 2] - 0.8 * x[:, 9]
    responses = {
        "bernoulli": (rng.random(900) < 1 / (1 + np.exp(-2 * eta))).astype(float),
        "poisson": rng.poisson(np.exp(eta)),
        "negbin": rng.poisson(rng.gamma(6, np.exp(eta) / 6)),
    }
    for family, y in responses.items():
        kept = em.em_filter_glm(from_arrays(spark, x, y).coalesce(2).persist(), np.zeros(14), family, em.Prior(xi0=-1.0, kappa=50.0), min_features=6, max_outer=3)
        _filtered(kept, {2, 9})
    _filtered(em.em_filter_gaussian(moments(rows), np.zeros(20), em.Prior(xi0=-1.0, kappa=50.0), tau=50 / 3), {3, 10})


def _filtered(fit, causal):
    """The step of least loss wins, steps get smaller, and the causal features lead it."""
    sizes = [h["n_features"] for h in fit.history]
    assert sizes == sorted(set(sizes), reverse=True) and len(sizes) > 1
    assert len(fit.retained) == min(fit.history, key=lambda h: h["loss"])["n_features"]
    assert {int(f) for f in fit.retained[np.argsort(-fit.theta, kind="stable")[:2]]} == causal


def test_classifier_and_counts(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(800, 4))
    y = (rng.random(800) < 1 / (1 + np.exp(-3 * x[:, 1]))).astype(float)
    labelled = from_arrays(spark, x, y).persist()
    c = SlabClassifier(xi0=-1.0, kappa=50.0).fit(labelled)
    right = c.predict_label(labelled).selectExpr("avg(CAST(label = y AS double)) AS a").first().a
    assert right > 0.8 and np.argmax(c.fit_.theta) == 1
    off = rng.uniform(0, 1, 800)
    n = rng.poisson(np.exp(0.2 + 0.7 * x[:, 0] + off))
    for family in ("poisson", "negbin"):
        m = SlabCountRegressor(family, xi0=-1.0, kappa=50.0).fit(from_arrays(spark, x, n, off).persist())
        assert np.allclose(m.fit_.beta[:2], [0.2, 0.7], atol=0.15) and m.clone().family == family
    with pytest.raises(ValueError):
        SlabCountRegressor("gamma")


def test_cross_validate_by_estimator(spark, rows):
    fit = lambda training: predictor(SlabRegressor(xi0=-1.0, kappa=50.0).fit(training.drop("fold")))
    scores = validate.cross_validate(rows, fit, 3)
    assert len(scores) == 3 and min(scores) > 0.5
    held = spark.createDataFrame([(0.9, 1.0), (0.2, 0.0), (0.6, 0.0), (0.5, 1.0)], "prediction double, y double")
    assert validate.accuracy(held).first().score == 0.75


def test_binomial_latents_in_the_classifier(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(150, 2))
    x = rng.binomial(2, 1 / (1 + np.exp(-2 * np.repeat(z, 3, axis=1)))).astype(float)
    x[:, 2] = 2 - x[:, 2]
    y = (rng.random(150) < 1 / (1 + np.exp(-3 * z[:, 0]))).astype(float)
    rows, ids = from_arrays(spark, x, y).coalesce(2).persist(), np.repeat([0, 1], 3)
    places = spark.createDataFrame([(j, float(j)) for j in range(6)], "feature_id long, s double")
    model = SlabClassifier(decorrelate="binomial_ar1", fit_method="joint", burn_in=80, n_samples=80).fit(rows, places, block_id=ids)
    assert list(model.flips_) == [False, False, True, False, False, False] or list(model.flips_[:3]) == [True, True, False]
    assert model.draws_.beta.shape == (160, 3) and model.cov_.shape == (3, 3)
    assert abs(model.fit_.beta[1]) > abs(model.fit_.beta[2]) and model.fit_.theta[0] >= model.fit_.theta[1]
    right = model.predict_label(rows).selectExpr("avg(CAST(label = y AS double)) AS a").first().a
    assert right > 0.65
    unseen = model.predict(rows.drop("y"))
    assert unseen.where("mean is null").count() == 0 and unseen.count() == 150
    with pytest.raises(ValueError):
        model.save(spark, "/tmp/never")
    for bad in ({"fit_method": "gibbs"}, {"firth": True}):
        with pytest.raises(ValueError):
            SlabClassifier(decorrelate="binomial_sar", **bad).fit(rows, places, block_id=ids)
    with pytest.raises(ValueError):
        SlabRegressor(decorrelate="binomial_sar").fit(rows, places, block_id=ids)
    with pytest.raises(ValueError):
        SlabClassifier(fit_method="joint").fit(rows)


def test_binomial_latents_by_em(spark, monkeypatch):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(150, 2))
    x = rng.binomial(2, 1 / (1 + np.exp(-2 * np.repeat(z, 2, axis=1)))).astype(float)
    y = (rng.random(150) < 1 / (1 + np.exp(-3 * z[:, 1]))).astype(float)
    rows, ids = from_arrays(spark, x, y).coalesce(1).persist(), np.repeat([0, 1], 2)
    places = spark.createDataFrame([(j, float(j)) for j in range(4)], "feature_id long, s double")
    short = latent.fit_latent
    monkeypatch.setattr(latent, "fit_latent", lambda *a, **how: short(*a, **how, n_outer=1, n_inner=2, hyper_steps=20))
    model = SlabClassifier(decorrelate="binomial_sar", xi0=-1.0, kappa=50.0).fit(rows, places, block_id=ids)
    assert np.argmax(np.abs(model.fit_.beta[1:])) == 1 and np.all(np.isfinite(model.cov_))


def test_variance_of_dynamic_latents_row_by_row(spark):
    """The covariance against the same sums in NumPy, where the smoother's variance differs between rows."""
    rng = np.random.default_rng(8)
    z = np.zeros(120)
    for t in range(1, 120):
        z[t] = 0.8 * z[t - 1] + rng.normal(scale=0.6)
    x = np.column_stack([z + rng.normal(scale=0.5, size=120) for _ in range(3)])
    rows = from_arrays(spark, x, 2 * z + rng.normal(size=120)).selectExpr("*", "row_id AS t").persist()
    places = spark.createDataFrame([(j, float(j)) for j in range(3)], "feature_id long, s double")
    m = SlabRegressor(decorrelate="ar1", xi0=0.0, kappa=50.0).fit(rows, places, block_id=np.zeros(3, int))
    score, var = dynamic.filter_dynamic(x, m.dynamic_[0])
    assert var.std() > 0
    design = np.column_stack([np.ones(120), score])
    w = 1 / (m.fit_.sigma_y2 + m.fit_.beta[1] ** 2 * var[:, 0])
    prior = np.diag(em.precisions(m.fit_.theta, 50.0) / m.fit_.sigma2)
    assert np.allclose(m.cov_, np.linalg.inv((design * w[:, None]).T @ design + prior), rtol=1e-6)


def test_coupled_latents_in_the_regressor(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(80, 2)).cumsum(0) * 0.3
    x = np.repeat(z, 2, axis=1) + rng.normal(scale=0.4, size=(80, 4))
    rows = from_arrays(spark, x, 2 * z[:, 0] + rng.normal(size=80)).selectExpr("*", "row_id AS t").persist()
    places = spark.createDataFrame([(j, float(j)) for j in range(4)], "feature_id long, s double")
    m = SlabRegressor(decorrelate="star", xi0=0.0, kappa=50.0).fit(rows, places, block_id=np.repeat([0, 1], 2))
    assert m.fit_.beta[1] > 5 * abs(m.fit_.beta[2]) and np.all(np.diag(m.cov_) > 0) and m.predict(rows).count() == 80
