"""Estimators on DataFrames: boost, decorrelate, select, predict, report."""

from __future__ import annotations

import inspect
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkslab.operators import copula, factor
from sparkslab.operators.affinity import resolve_affinity
from sparkslab.operators.blocks import determine_blocks
from sparkslab.operators.suffstats import moments, right_vectors, truncate, weighted_rows, whole_rows
from sparkslab.plans import dynamic, em, gibbs, joint, latent, resample, statespace, validate
from sparkslab.plans.stage import stage
from sparkslab.sources.tables import load_model, save_model

_STATIC = ("ppca", "pls", "sar_shrink")
#: Latents of Binomial features, by the structure of their means.
_DISCRETE = {"binomial_sar": "sar", "binomial_ar1": "ar1"}
#: Rows up to which the joint model samples every row's score; more raise ValueError.
JOINT_ROWS = 20_000


#: Steps of a trajectory up to which a dynamic factor is fitted on the driver; longer ones are scanned.
GATHERED = 20_000
#: What is stored of a dynamic factor.
_DYNAMIC = ("loadings", "noise", "owner", "phi", "q", "mean", "loglik", "rho")
#: Folder of a marginal's knots inside a saved model's; readers of the model pass over names that begin so.
_KNOTS = "_knots"


class SlabEstimator:
    """Common part of the classifier and the regressors.

    ``fit(rows)`` takes wide rows (row_id, y, x[, off, t]).  ``features`` with
    (feature_id, s or coord or t) gives places, ``groups`` what they are boosted
    by.  ``decorrelate`` is None, ppca, pls, sar_shrink, ar1 or star; the last two
    order rows by t.  A classifier's features may be Binomial counts of
    ``n_trials``: binomial_sar or binomial_ar1, by ``fit_method`` em or joint (a
    posterior over all scores of at most ``JOINT_ROWS`` rows).  With ``marginal``
    "copula", latents are made of the features' normal scores, by the training
    rows' distribution functions, for new rows too.
    """

    family = "gaussian"

    def __init__(self, xi0: float = -2.0, xi1: float = 0.0, kappa: float = 100.0, nu: float = 1.0, lam: float = 1.0, fit_method: str = "em", decorrelate: str | None = None, block_method: str = "threshold", zeta: float | None = None, rho_threshold: float = 0.3, rank: int | None = None, n_samples: int = 2000, burn_in: int = 500, thin: int = 1, filter_frac: float = 0.25, min_features: int = 10, max_outer: int = 200, patience: int = 3, random_state: int = 0, phi_star: float | None = None, tau: float | None = None, cv_folds: int | None = None, firth: bool = False, r_init: float = 10.0, n_trials: float = 2, tau2: float = 1.0, p0_joint: float | None = None, slab_scale_joint: float = 2.0, practical_joint: float = 0.1, alpha: float | str = 0.1, marginal: str | None = None) -> None:
        for k, v in locals().items():
            if k not in ("self", "__class__"):
                setattr(self, k, v)
        self.fit_: em.Fit | None = None

    def get_params(self) -> dict:
        """Hyper-parameters by name."""
        return {k: getattr(self, k) for k in inspect.signature(SlabEstimator.__init__).parameters if k != "self"}

    def set_params(self, **params) -> SlabEstimator:
        """Change hyper-parameters; an unknown name raises ValueError."""
        for k, v in params.items():
            if k not in self.get_params():
                raise ValueError(f"no parameter {k!r}")
            setattr(self, k, v)
        return self

    def clone(self) -> SlabEstimator:
        """An unfitted copy."""
        return type(self)(**self.get_params())

    def _check(self) -> None:
        if self.fit_ is None:
            raise RuntimeError("fit the estimator first")

    def _prior(self) -> em.Prior:
        return em.Prior(self.xi0, self.xi1, self.kappa, self.nu, self.lam)

    def fit(self, rows: DataFrame, features: DataFrame | None = None, groups: DataFrame | None = None, block_id: np.ndarray | None = None, affinity: str = "gaussian", bandwidth: float | None = None, edges: DataFrame | None = None, names: list[str] | None = None) -> SlabEstimator:
        """Learn from wide rows; see the class for the tables."""
        if self.decorrelate and self.decorrelate not in (*_STATIC, *_DISCRETE, "ar1", "star"):
            raise ValueError(f"unknown decorrelation {self.decorrelate!r}")
        if self.decorrelate and features is None and block_id is None:
            raise ValueError("decorrelation needs the features' places, or blocks")
        if self.fit_method == "gibbs" and self.family == "poisson":
            raise ValueError("there is no Gibbs sampler for a Poisson response")
        self._reject_unused()
        self.draws_, self.latent_, self.flips_, self.knots_ = None, None, None, None
        if "off" not in rows.columns:
            rows = rows.withColumn("off", F.lit(0.0))
        if self.family in ("gaussian", "bernoulli"):
            rows = rows.withColumn("off", F.lit(0.0))
        head = whole_rows(rows.select("y", "x")).first()
        if head is None:
            raise ValueError("no row without a null to learn from")
        self.p_ = len(head.x)
        self.raw_names_ = names or [f"x{j}" for j in range(self.p_)]
        wr = np.zeros(self.p_)
        if groups is not None or edges is not None:
            related = self._correlations(rows) if bandwidth is None and affinity in ("gaussian", "causal") and self.p_ > 1 else None
            for r in resolve_affinity(affinity, features, groups, bandwidth, edges, correlations=related).collect():
                wr[int(r.feature_id)] = r.wr
        self.blocks_, self.factors_, self.dynamic_, self.coords_ = None, None, None, None
        if self.decorrelate:
            self.blocks_ = np.asarray(block_id) if block_id is not None else self._blocks(rows, features)
            wr = np.array([wr[self.blocks_ == b].mean() for b in np.unique(self.blocks_)])
            if self.marginal:
                self.knots_ = stage(copula.wide_ecdf(whole_rows(rows)), "knots")
                rows = stage(copula.wide_scores(rows, self.knots_), "scores")
            if self.decorrelate not in _DISCRETE:
                self._fit_latents(rows, features)
            self.names_ = [f"block{b}" for b in np.unique(self.blocks_)]
        else:
            self.names_ = self.raw_names_
        self.wr_ = wr
        if self.decorrelate in _DISCRETE:
            design = self._fit_discrete(rows, features, wr)
        else:
            design = stage(self._of_latents(rows), "design")
            self.fit_ = self._select(design.drop("z_var"), wr)
        self.retained_ = self.fit_.retained if self.fit_.retained is not None else np.arange(len(wr))
        self.names_ = [self.names_[j] for j in self.retained_]
        self.cov_ = self._covariance(em.take_features(design, self.retained_))
        return self

    def _fit_discrete(self, rows: DataFrame, features: DataFrame, wr: np.ndarray) -> DataFrame:
        """Binomial latents and the fit on them; returns the training design."""
        coords = np.array([r.s for r in features.orderBy("feature_id").collect()], float)
        self.flips_ = factor.sign_flips(moments(rows), self.blocks_)
        rows = rows.withColumn("x", factor.flip(F.col("x"), self.flips_, self.n_trials))
        structure = _DISCRETE[self.decorrelate]
        if self.fit_method == "em":
            out = latent.fit_latent(whole_rows(rows), coords, self.blocks_, wr, self._prior(), self.n_trials, structure=structure, tau2=self.tau2)
            self.fit_, self.latent_ = out["fit"], (out["fits"], out["deltas"], None)
            return out["scores"].select("row_id", "y", F.col("z").alias("x"), F.lit(0.0).alias("off"))
        sample = whole_rows(rows).select("row_id", "y", "x").limit(JOINT_ROWS + 1).collect()
        if len(sample) > JOINT_ROWS:
            raise ValueError(f"the joint model serves at most {JOINT_ROWS} rows")
        sample.sort(key=lambda r: r.row_id)
        fits = latent.fit_blocks(rows.sparkSession, *factor.covariance(moments(rows)), coords, self.blocks_, self.n_trials, self.tau2, structure)
        model = joint.JointModel(np.array([r.x for r in sample], float), np.array([r.y for r in sample], float), self.blocks_, fits, self.p0_joint, self.slab_scale_joint)
        tau, beta, loadings, deltas = joint.posterior(rows.sparkSession, model, seed=self.random_state, warmup=self.burn_in, samples=self.n_samples)
        chosen = np.abs(beta[:, 1:]) > self.practical_joint
        self.fit_ = self._from_draws(gibbs.Draws(beta, chosen, tau))
        self.latent_ = (fits, deltas, loadings)
        return self._scores(rows)

    def _scores(self, rows: DataFrame) -> DataFrame:
        """Scores of Binomial rows, already flipped, from their features alone."""
        fits, deltas, loadings = self.latent_
        z = latent.infer_scores(rows, fits, self.blocks_, deltas, loadings=loadings)
        return z.select("row_id", "y", F.col("z").alias("x"), F.lit(0.0).alias("off"))

    def _reject_unused(self) -> None:
        """Options that the chosen family and method have no use for raise ValueError."""
        gaussian, method = self.family == "gaussian", self.fit_method
        if method not in ("em", "em_filter", "gibbs", "joint"):
            raise ValueError(f"unknown method {method!r}")
        discrete = self.decorrelate in _DISCRETE
        if discrete and (self.family != "bernoulli" or method not in ("em", "joint")):
            raise ValueError("Binomial latents serve a Bernoulli response by em or joint")
        if self.marginal not in (None, "copula"):
            raise ValueError(f"unknown marginal {self.marginal!r}")
        if self.marginal and (discrete or not self.decorrelate):
            raise ValueError("a marginal serves continuous features that are decorrelated")
        if discrete and (self.rank or self.firth):
            raise ValueError("rank and firth have no effect on Binomial latents")
        if method == "joint" and not discrete:
            raise ValueError("the joint method needs Binomial latents")
        unused = {"cv_folds": method != "em_filter" and self.alpha != "cv", "rank": not gaussian and method == "em_filter", "firth": gaussian or method != "em", "tau": not gaussian or method == "gibbs"}
        for name, idle in unused.items():
            if idle and getattr(self, name):
                raise ValueError(f"{name} has no effect on a {self.family} response by {method}")

    def _correlation(self, rows: DataFrame) -> np.ndarray:
        _, cov = factor.covariance(moments(rows))
        sd = np.sqrt(np.diag(cov)) + 1e-8
        return cov / np.outer(sd, sd)

    def _correlations(self, rows: DataFrame) -> DataFrame:
        """(i, j, r) of the features' pairs, i < j."""
        r = self._correlation(rows)
        i, j = np.triu_indices(self.p_, 1)
        return rows.sparkSession.createDataFrame(list(zip(i.tolist(), j.tolist(), r[i, j].tolist(), strict=True)), "i long, j long, r double")

    def _blocks(self, rows: DataFrame, features: DataFrame) -> np.ndarray:
        how = {"threshold": {"zeta": self.zeta}, "kmeans": {"seed": self.random_state}}.get(self.block_method, {})
        if self.block_method in ("correlation", "glasso"):
            folds = moments(rows.withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(self.cv_folds or 5))), by="fold") if self.alpha == "cv" else None
            how = {"covariance": self._correlation(rows), "alpha": self.alpha, "folds": folds} if self.block_method == "glasso" else {"rho": self.rho_threshold, "correlations": self._correlations(rows)}
        found = {int(r.feature_id): r.block_id for r in determine_blocks(features, self.block_method, **how).collect()}
        return np.array([found[j] for j in range(self.p_)])

    def _fit_latents(self, rows: DataFrame, features: DataFrame | None) -> None:
        if self.decorrelate in _STATIC:
            if self.decorrelate == "sar_shrink":
                self.coords_ = np.array([r.s for r in features.orderBy("feature_id").collect()], float)
            self.factors_ = factor.block_factors(moments(rows), self.blocks_, self.decorrelate, self.coords_)
            return
        ids, coupling = np.unique(self.blocks_), None
        self.coupling_ = None
        owner = np.searchsorted(ids, self.blocks_)
        if self.decorrelate == "star":
            at = np.array([r.s for r in features.orderBy("feature_id").collect()], float)
            centres = np.array([at[self.blocks_ == b].mean() for b in ids])
            phi = self.phi_star or float(np.median(np.diff(np.sort(centres)))) if len(ids) > 1 else 1.0
            self.coupling_ = coupling = factor.sar_matrix(centres, phi)
        steps = whole_rows(rows.select("t", "x").withColumn("y", F.lit(0.0))).drop("y")
        few = steps.limit(GATHERED + 1).toPandas()
        if len(few) > GATHERED:  # a long trajectory: buckets of time
            self.dynamic_ = statespace.fit_states(steps, owner, coupling)
            return
        x = np.stack(few.sort_values("t", kind="stable", na_position="first")["x"].to_numpy())
        self.dynamic_ = [dynamic.fit_dynamic(x, owner, coupling)] if coupling is not None else [dynamic.fit_dynamic(x[:, owner == b]) for b in range(len(ids))]

    def design(self, rows: DataFrame) -> DataFrame:
        """(row_id, y, x, off) with latents in the place of features; new rows use what the training rows gave."""
        return self._noisy(rows).drop("z_var")

    def _noisy(self, rows: DataFrame) -> DataFrame:
        """``design``; of dynamic latents with z_var, the variances of the row's latents."""
        if "off" not in rows.columns:
            rows = rows.withColumn("off", F.lit(0.0))
        if "y" not in rows.columns:
            rows = rows.withColumn("y", F.lit(None).cast("double"))
        if self.latent_ is not None:
            flipped = rows.withColumn("x", factor.flip(F.col("x"), self.flips_, self.n_trials))
            return self._scores(flipped.withColumn("y", F.col("y").cast("double")))
        return self._of_latents(rows if self.knots_ is None else copula.wide_scores(rows, self.knots_))

    def _of_latents(self, rows: DataFrame) -> DataFrame:
        """``_noisy`` of rows whose features are on the latents' scale."""
        if self.factors_ is not None:
            return factor.scores(rows, self.factors_, self.blocks_).select("row_id", "y", "x", "off")
        if self.dynamic_ is not None:
            f = self.dynamic_[0]
            if len(self.dynamic_) > 1:
                f = statespace.joined(self.dynamic_, [np.flatnonzero(self.blocks_ == b) for b in np.unique(self.blocks_)])
            got = statespace.states(rows.select("row_id", "y", "off", "t", "x"), f, smooth=True)
            return got.select("row_id", "y", F.col("z").alias("x"), "off", "z_var")
        return rows.select("row_id", "y", "x", "off")

    def _select(self, design: DataFrame, wr: np.ndarray) -> em.Fit:
        prior = self._prior()
        outer = {"filter_frac": self.filter_frac, "min_features": self.min_features, "max_outer": self.max_outer, "patience": self.patience}
        if self.family == "gaussian":
            m = moments(design)
            if self.fit_method == "gibbs":
                return self._from_draws(gibbs.gibbs_gaussian(m, wr, prior, self.n_samples, self.burn_in, self.thin, self.random_state, rank=self.rank))
            if self.rank:
                m, self.rank_error_ = truncate(m, self.rank)
            if self.fit_method == "em_filter":
                folds = moments(design.withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(self.cv_folds))), by="fold") if self.cv_folds else None
                return em.em_filter_gaussian(m, wr, prior, tau=self.tau, folds=folds, **outer)
            return em.em_gaussian(m, wr, prior, tau=self.tau)
        if self.fit_method == "em_filter":
            folds = {"folds": "_fold", "n_folds": self.cv_folds} if self.cv_folds else {}
            if folds:
                design = design.withColumn("_fold", F.pmod(F.xxhash64("row_id"), F.lit(self.cv_folds)))
            return em.em_filter_glm(design, wr, self.family, prior, self.r_init, **folds, **outer)
        if self.fit_method == "gibbs":
            return self._from_draws(gibbs.gibbs_glm(design, wr, self.family, prior, self.n_samples, self.burn_in, self.thin, self.random_state, self.r_init, rank=self.rank))
        vectors = right_vectors(moments(design), self.rank) if self.rank else None
        return em.em_glm(design, wr, self.family, prior, r=self.r_init, firth=self.firth, vectors=vectors)

    def _from_draws(self, d: gibbs.Draws) -> em.Fit:
        self.draws_ = d
        return em.Fit(d.beta.mean(0), float(d.sigma2.mean()), d.pi, len(d.beta), float(d.sigma_y2.mean()) if d.sigma_y2 is not None else None, float(d.r.mean()) if d.r is not None else None)

    def _covariance(self, design: DataFrame) -> np.ndarray:
        """Laplace approximation; noisy latents widen a Gaussian response's variance by theirs, row by row where it differs. Of draws, their own."""
        if getattr(self, "draws_", None) is not None:
            return np.cov(self.draws_.beta, rowvar=False)
        f = self.fit_
        prior = np.diag(em.precisions(f.theta, self.kappa) / f.sigma2)
        if self.family == "gaussian":
            own = f.sigma_y2
            if self.dynamic_ is not None:
                parts = [F.element_at("z_var", int(j) + 1) * float(b * b) for j, b in zip(self.retained_, f.beta[1:], strict=True)]
                noisy = design.withColumn("off", sum(parts, F.lit(0.0)))
                gram = weighted_rows(noisy, f.beta, lambda eta, y, extra: (1 / (own + extra), y / (own + extra), extra))[0]
            else:
                z_vars = [x.z_var for x in self.factors_.values()] if self.factors_ else np.zeros(len(self.wr_))
                gram = moments(design).gram / (own + sum(b * b * z_vars[j] for j, b in zip(self.retained_, f.beta[1:], strict=True)))
        else:
            fam, r = em.Family(self.family), f.r
            gram = weighted_rows(design, f.beta, lambda eta, y, off: fam.step(eta, y, off, r))[0]
        try:
            return np.linalg.inv(gram + prior)
        except np.linalg.LinAlgError:
            return np.full_like(gram, np.nan)

    def predict(self, rows: DataFrame, ci: float = 0.95) -> DataFrame:
        """(row_id, y, mean, std, lower, upper): a narrow projection with the model as literals."""
        self._check()
        found = len(rows.select("x").first().x)
        if found != self.p_:
            raise ValueError(f"{found} features; the model was fitted to {self.p_}")
        design = em.take_features(self.design(rows), self.retained_)
        link = {"gaussian": "identity", "bernoulli": "logit"}.get(self.family, "log")
        if link == "log":  # the offset moves the intercept row by row
            design = design.withColumn("x", F.concat("x", F.array("off")))
            beta = np.append(self.fit_.beta, 1.0)
            cov = np.pad(self.cov_, (0, 1))
        else:
            beta, cov = self.fit_.beta, self.cov_
        return validate.predict_interval(design, beta, cov, link, ci).drop("x", "off")

    def summary_df(self, spark: SparkSession, ci: float = 0.95, top_n: int | None = None) -> DataFrame:
        """(rank, name, theta, beta, se, lower, upper), likeliest first."""
        self._check()
        z, se = NormalDist().inv_cdf((1 + ci) / 2), np.sqrt(np.maximum(np.diag(self.cov_), 0))
        order = np.lexsort((np.arange(len(self.names_)), -self.fit_.theta))[:top_n]
        rows = [(k + 1, self.names_[j], float(self.fit_.theta[j]), float(self.fit_.beta[1 + j]), float(se[1 + j]), float(self.fit_.beta[1 + j] - z * se[1 + j]), float(self.fit_.beta[1 + j] + z * se[1 + j])) for k, j in enumerate(order)]
        return spark.createDataFrame(rows, "rank int, name string, theta double, beta double, se double, lower double, upper double")

    def summary(self, top_n: int = 15, ci: float = 0.95, gamma: float = 1.0) -> str:
        """A text report: the configuration, the fit's quality and the likeliest features."""
        self._check()
        f, z, se = self.fit_, NormalDist().inv_cdf((1 + ci) / 2), np.sqrt(np.maximum(np.diag(self.cov_), 0))
        chosen = f.theta[f.theta >= 1 / (1 + gamma)]
        out = [f"{type(self).__name__}: family {self.family}, method {self.fit_method}, decorrelation {self.decorrelate}{f', marginal {self.marginal}' if self.marginal else ''}", f"features {len(f.theta)}, iterations {f.n_iter}, loss {f.ppl}, EMBFDR {float(np.mean(1 - chosen)) if len(chosen) else 0.0:.4f}", f"{'name':<16}{'theta':>8}{'beta':>12}{'se':>10}{'lower':>12}{'upper':>12}"]
        for j in np.lexsort((np.arange(len(f.theta)), -f.theta))[:top_n]:
            b, s = f.beta[1 + j], se[1 + j]
            out.append(f"{self.names_[j]:<16}{f.theta[j]:>8.4f}{b:>12.4f}{s:>10.4f}{b - z * s:>12.4f}{b + z * s:>12.4f}")
        return "\n".join(out)

    def describe_blocks(self, spark: SparkSession, top_n: int | None = None) -> DataFrame:
        """(name, theta, beta, n_members, members) of the blocks kept, likeliest first."""
        self._check()
        if self.blocks_ is None:
            raise RuntimeError("the model has no blocks")
        by = {f"block{b}": [self.raw_names_[j] for j in np.flatnonzero(self.blocks_ == b)] for b in np.unique(self.blocks_)}
        rows = [(n, float(t), float(b), len(by[n]), by[n]) for n, t, b in zip(self.names_, self.fit_.theta, self.fit_.beta[1:], strict=True)]
        out = spark.createDataFrame(rows, "name string, theta double, beta double, n_members int, members array<string>").orderBy(F.desc("theta"), "name")
        return out.limit(top_n) if top_n else out

    def plot_data(self, spark: SparkSession, kind: str, rows: DataFrame | None = None, bins: int = 30) -> DataFrame:
        """What a plot of this kind shows: inclusion, coefficients, history, residuals and fitted against actual (of ``rows``), loadings or latent (of all coupled factors; with ``rows``, of these, by row_id)."""
        self._check()
        if kind in ("inclusion", "coefficients"):
            return self.summary_df(spark)
        if kind == "history":
            return spark.createDataFrame([(k, int(h["n_features"]), float(h["ppl"])) for k, h in enumerate(self.fit_.history)], "step int, n_features int, ppl double")
        if kind == "residuals":
            e = self.predict(rows).select((F.col("y") - F.col("mean")).alias("e"))
            low, high = e.agg(F.min("e"), F.max("e")).first()
            width = (high - low) / bins or 1.0
            return e.groupBy(F.least(F.floor((F.col("e") - low) / width), F.lit(bins - 1)).alias("bin")).count().select((F.col("bin") * width + low).alias("left"), "count")
        if kind == "loadings" and self.factors_:
            return spark.createDataFrame([(int(b), k, float(v)) for b, f in self.factors_.items() for k, v in enumerate(f.loading)], "block_id long, member int, loading double")
        if kind == "latent" and self.dynamic_:
            if rows is not None:
                one = self._noisy(rows).select("row_id", F.posexplode(F.arrays_zip(F.col("x").alias("z"), F.col("z_var"))).alias("latent", "v"))
                made = one.select("latent", F.col("row_id").alias("t"), F.col("v.z").alias("z"), F.sqrt("v.z_var").alias("sd"))
            else:
                if not any(len(f.z) for f in self.dynamic_):
                    raise ValueError("the states of a long trajectory are not kept: pass its rows")
                z, v = (np.column_stack([getattr(f, name) for f in self.dynamic_]) for name in ("z", "z_var"))
                made = spark.createDataFrame([(i, t, float(z[t, i]), float(v[t, i] ** 0.5)) for i in range(z.shape[1]) for t in range(len(z))], "latent int, t long, z double, sd double")
            return made.select("latent", "t", "z", (F.col("z") - 2 * F.col("sd")).alias("lower"), (F.col("z") + 2 * F.col("sd")).alias("upper"))
        if kind == "fitted":
            return self.predict(rows).select("row_id", F.col("mean").alias("fitted"), F.col("y").alias("actual"))
        raise RuntimeError(f"the model has no {kind!r} to show")

    def bootstrap_ci(self, rows: DataFrame, n_boot: int = 200, ci: float = 0.95) -> dict:
        """Percentile intervals with factors and fit made anew in each resample: of moments for a Gaussian response, by reweighted passes for the others, of moving blocks of time for dynamic factors."""
        self._check()
        if self.fit_method != "em" or self.latent_ is not None or self.firth:
            raise ValueError("resampling serves fits by EM, without Binomial latents and Firth's correction")
        if self.knots_ is not None:
            raise ValueError("resampling doesn't rank the features anew, so it serves no marginal")
        if self.family != "gaussian" and (self.dynamic_ is not None or self.rank):
            raise ValueError("resampling with dynamic factors or a rank serves a Gaussian response")
        ids, prior, wr, coords = self.blocks_, self._prior(), self.wr_, self.coords_

        def scores(m):
            """[1, x] to [1, the blocks' scores]."""
            fs = factor.block_factors(m, ids, self.decorrelate, coords)
            a = np.zeros((len(fs) + 1, len(m.xty)))
            a[0, 0] = 1
            for k, (b, f) in enumerate(fs.items()):
                a[1 + k, 1 + np.flatnonzero(ids == b)] = f.coef
                a[1 + k, 0] = -f.coef @ f.mean
            return a

        rank, tau = self.rank, self.tau

        def on_moments(m):
            return em.em_gaussian(truncate(m, rank)[0] if rank else m, wr, prior, tau=tau).beta

        def fit(m):
            if self.factors_ is not None:
                a = scores(m)
                m = em.Moments(m.n, a @ m.gram @ a.T, a @ m.xty, m.yty)
            return on_moments(m)

        if self.dynamic_ is not None:
            few = whole_rows(rows.select("t", "x", "y")).limit(GATHERED + 1).toPandas().sort_values("t", kind="stable", na_position="first")
            if len(few) > GATHERED:
                raise ValueError(f"moving blocks serve trajectories of at most {GATHERED} steps")
            owner = np.searchsorted(np.unique(ids), ids)
            x, y = np.stack(few["x"].to_numpy()).astype(float), few["y"].to_numpy(float)
            return validate.intervals(resample.dynamic_resampled(rows.sparkSession, x, y, owner, self.coupling_, on_moments, n_boot, self.random_state), ci)
        if self.family != "gaussian":
            if "off" not in rows.columns or self.family == "bernoulli":
                rows = rows.withColumn("off", F.lit(0.0))
            maps = [scores(m) for m in validate.bootstrap_moments(rows, n_boot, self.random_state)] if self.factors_ is not None else None
            return validate.intervals(resample.em_glm_resampled(rows, wr, self.family, prior, n_boot, self.random_state, self.fit_.r or self.r_init, maps), ci)
        return validate.bootstrap_ci(rows, fit, n_boot, ci, self.random_state)

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters and arrays under ``path``; of dynamic latents all but the training states; of a marginal its knots, in the same folder. A model with Binomial latents raises ValueError."""
        self._check()
        if self.latent_ is not None:
            raise ValueError("models with Binomial latents are not stored")
        arrays = {"beta": self.fit_.beta, "theta": self.fit_.theta, "cov": self.cov_.ravel(), "retained": self.retained_, "wr": self.wr_, "scales": [self.fit_.sigma2, self.fit_.sigma_y2 or 0.0, self.fit_.r or 0.0, self.p_, self.fit_.n_iter]}
        if self.factors_:
            arrays["blocks"] = self.blocks_
            for b, f in self.factors_.items():
                for k in ("loading", "coef", "mean", "sigma2"):
                    arrays[f"{k}:{b}"] = getattr(f, k)
                arrays[f"z_var:{b}"] = [f.z_var]
        if self.dynamic_:
            arrays["blocks"] = self.blocks_
            for b, f in enumerate(self.dynamic_):
                arrays |= {f"{k}:{b}": np.ravel(getattr(f, k)) for k in _DYNAMIC}
        save_model(spark, path, type(self).__name__, {"params": self.get_params(), "names": self.names_, "raw_names": self.raw_names_, "family": self.family}, {k: list(np.asarray(v, float)) for k, v in arrays.items()})
        if self.knots_ is not None:
            self.knots_.write.mode("overwrite").parquet(f"{path}/{_KNOTS}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlabEstimator:
        """What ``save`` stored; another class raises TypeError."""
        meta, a = load_model(spark, path, cls.__name__)
        out = cls(**meta["params"])
        out.family, out.names_, out.raw_names_ = meta["family"], meta["names"], meta["raw_names"]
        s = a["scales"]
        out.fit_ = em.Fit(np.array(a["beta"]), s[0], np.array(a["theta"]), int(s[4]), s[1] or None, s[2] or None)
        out.p_, out.retained_, out.wr_ = int(s[3]), np.array(a["retained"], int), np.array(a["wr"])
        out.cov_ = np.array(a["cov"]).reshape(len(out.fit_.beta), -1)
        out.blocks_ = np.array(a["blocks"], int) if "blocks" in a else None
        out.factors_, out.dynamic_, out.coords_, out.latent_, out.flips_, out.draws_ = None, None, None, None, None, None
        out.knots_ = spark.read.parquet(f"{path}/{_KNOTS}") if out.marginal else None
        if "phi:0" in a:
            out.dynamic_ = []
            while f"phi:{len(out.dynamic_)}" in a:
                got = {k: np.array(a[f"{k}:{len(out.dynamic_)}"]) for k in _DYNAMIC}
                k = len(got["q"])
                out.dynamic_.append(dynamic.Dynamic(**got | {"owner": got["owner"].astype(int), "phi": got["phi"].reshape(k, k), "loglik": got["loglik"].tolist(), "rho": tuple(got["rho"])}, z=np.zeros((0, k)), z_var=np.zeros((0, k))))
        elif out.blocks_ is not None:
            out.factors_ = {int(b): factor.Factor(*(np.array(a[f"{k}:{b}"]) for k in ("loading", "coef", "mean", "sigma2")), a[f"z_var:{b}"][0]) for b in np.unique(out.blocks_)}
        return out


class SlabRegressor(SlabEstimator):
    """Gaussian response."""


class SlabClassifier(SlabEstimator):
    """Bernoulli response."""

    family = "bernoulli"

    def predict_label(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``predict`` with label: 1 where the mean reaches the threshold."""
        return self.predict(rows).withColumn("label", (F.col("mean") >= threshold).cast("int"))


class SlabCountRegressor(SlabEstimator):
    """Poisson or negative-binomial response, with offsets in ``off``."""

    def __init__(self, family: str = "poisson", **params) -> None:
        super().__init__(**params)
        if family not in ("poisson", "negbin"):
            raise ValueError(f"no count family {family!r}")
        self.family = family

    def clone(self) -> SlabCountRegressor:
        """An unfitted copy."""
        return type(self)(self.family, **self.get_params())


def predictor(model: SlabEstimator):
    """The model's linear predictor as a function of the x column, for ``validate.cross_validate``."""

    def of(x: Column) -> Column:
        return validate.linear(F.transform(F.array(*[F.lit(int(i)) for i in model.retained_]), lambda i: F.element_at(x, i + 1)), model.fit_.beta)

    return of
