"""Spike-and-slab fits by EM: one core on sufficient statistics, one on reweighted passes.

A Gaussian response needs a single pass over the rows; all iterations, and all
rounds of feature elimination and cross-validation, run on p-by-p matrices.
The other families cost one small aggregate a iteration.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.functions.linalg import EigenSurrogate, effective_rank, minimize, woodbury_solve
from sparkslab.operators.suffstats import Moments, from_summary, matrix, moments, weighted_rows, whole_rows


@dataclass(frozen=True)
class Prior:
    """Hyper-parameters of the spike and slab."""

    xi0: float = -2.0
    xi1: float = 0.0
    kappa: float = 100.0
    nu: float = 1.0
    lam: float = 1.0
    nu_y: float = 1.0
    lam_y: float = 1.0


@dataclass
class Fit:
    """A fitted model: coefficients (intercept first), scales, inclusion probabilities."""

    beta: np.ndarray
    sigma2: float
    theta: np.ndarray
    n_iter: int
    sigma_y2: float | None = None
    r: float | None = None
    ppl: float | None = None
    retained: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)


def theta_local(beta: np.ndarray, sigma2: float, prior: Prior, wr: np.ndarray) -> np.ndarray:
    """Inclusion probabilities under the local slab."""
    k = prior.kappa
    logit = -0.5 * math.log(k) + beta**2 * (1 - 1 / k) / (2 * sigma2) + prior.xi0 + prior.xi1 * wr
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def theta_pmom(beta: np.ndarray, sigma2: float, tau: float, prior: Prior, wr: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Inclusion probabilities under the product-moment slab."""
    b2 = beta**2
    logit = np.log(np.maximum(b2, eps)) - 1.5 * math.log(tau) - math.log(sigma2) + b2 * (1 - 1 / tau) / (2 * sigma2) + prior.xi0 + prior.xi1 * wr
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def precisions(theta: np.ndarray, kappa: float) -> np.ndarray:
    """Prior precisions, the intercept's (always in the slab) first."""
    return np.concatenate([[1 / kappa], theta / kappa + 1 - theta])


def _moved(new: np.ndarray, old: np.ndarray) -> float:
    return float(np.linalg.norm(new - old) / (np.linalg.norm(old) + 1e-12))


def em_gaussian(m: Moments, wr: np.ndarray, prior: Prior = Prior(), beta: np.ndarray | None = None, sigma2: float = 1.0, sigma_y2: float = 1.0, max_iter: int = 200, tol: float = 1e-8, tau: float | None = None, max_step: float = 5.0, eps: float = 1e-6, sigma2_fixed: bool = False, surrogate: EigenSurrogate | None = None) -> Fit:
    """Gaussian response from its moments; with ``tau`` the product-moment slab.

    With a ``surrogate`` of the features' correlations, solves go through its
    rank instead of p.
    """
    p1 = len(m.xty)
    pmom = tau is not None
    slab = tau if pmom else prior.kappa
    if beta is None:
        beta = np.linalg.solve(m.gram + np.eye(p1), m.xty) if pmom else np.zeros(p1)
    include = (lambda b, s: theta_pmom(b, s, tau, prior, wr, eps)) if pmom else (lambda b, s: theta_local(b, s, prior, wr))
    for it in range(1, max_iter + 1):
        theta = include(beta[1:], sigma2)
        prec = precisions(theta, slab)
        if not sigma2_fixed:
            sigma2 = (0.5 * np.sum(beta**2 * prec) + prior.lam) / (p1 / 2 + prior.nu + 1 + (theta.sum() if pmom else 0))
        sigma_y2 = (0.5 * m.ssr(beta) + prior.lam_y) / (m.n / 2 + prior.nu_y + 1)
        diagonal, rhs = prec / sigma2, m.xty / sigma_y2
        if pmom:
            held = np.where(beta[1:] < 0, -1, 1) * np.maximum(np.abs(beta[1:]), eps)
            diagonal = diagonal + np.concatenate([[0], 2 * theta / held**2])
            rhs = rhs + np.concatenate([[0], 4 * theta / held])
        if surrogate is not None:
            rest = woodbury_solve(surrogate.factor(1 / sigma_y2, m.n), 1 / diagonal[1:], rhs[1:])
            new = np.concatenate([[rhs[0] / (m.n / sigma_y2 + diagonal[0])], rest])
        else:
            new = np.linalg.solve(m.gram / sigma_y2 + np.diag(diagonal), rhs)
        if pmom:
            new = beta + np.clip(new - beta, -max_step, max_step)
        moved, beta = _moved(new, beta), new
        if moved < tol:
            break
    out = Fit(beta, float(sigma2), include(beta[1:], sigma2), it, float(sigma_y2))
    out.ppl = m.ssr(beta) + m.n * out.sigma_y2
    return out


def em_sumstats(r: np.ndarray, bhat: np.ndarray, n: float, wr: np.ndarray, prior: Prior = Prior(), y_var: float = 1.0, rank: int | str | None = None, **how) -> Fit:
    """Gaussian fit from correlations, marginal coefficients and n; ``rank="auto"`` keeps the numerical rank."""
    if rank is None:
        return em_gaussian(from_summary(r, bhat, n, y_var), wr, prior, **how)
    s = EigenSurrogate(np.asarray(r, float), effective_rank(r) if rank == "auto" else int(rank))
    return em_gaussian(from_summary(s.matrix(), s.project(np.asarray(bhat, float)), n, y_var), wr, prior, surrogate=s, **how)


class Family:
    """Link, weight, working response and predictive variance of a response."""

    def __init__(self, name: str) -> None:
        self.name = name

    def mean(self, eta):
        """Inverse link."""
        return 1 / (1 + np.exp(-np.clip(eta, -700, 700))) if self.name == "bernoulli" else np.exp(np.clip(eta, -30, 30))

    def step(self, eta, y, off, r):
        """(weights, weighted working responses, predictive loss) of the rows."""
        if self.name == "bernoulli":
            mu = self.mean(eta)
            w = np.maximum(mu * (1 - mu), 1e-6)
            return w, w * eta + (y - mu), (y - mu) ** 2 + mu * (1 - mu)
        mu = self.mean(eta + off)
        if self.name == "poisson":
            w = np.maximum(mu, 1e-6)
            return w, w * eta + (y - mu), (y - mu) ** 2 + mu
        w = np.maximum(mu * r / (r + mu), 1e-6)
        return w, w * (eta + (y - mu) / np.maximum(mu, 1e-6)), (y - mu) ** 2 + mu + mu * mu / r


def negbin_r(rows: DataFrame, beta: np.ndarray, bounds: tuple[float, float] = (1e-3, 1e6)) -> float:
    """Profile maximum-likelihood dispersion with the means held.

    Two passes evaluate the log-likelihood on a grid of log r, the second
    around the first's best; a parabola through the top three finishes.
    """
    low, high = np.log(bounds[0]), np.log(bounds[1])
    for _ in range(3):
        grid = np.linspace(low, high, 33)

        def run(batches, grid=grid):
            total = np.zeros(len(grid))
            for b in batches:
                if b.num_rows:
                    y, x, off = np.asarray(b.column(0), float), matrix(b.column(1)), np.asarray(b.column(2), float)
                    mu = np.exp(np.clip(np.column_stack([np.ones(len(y)), x]) @ beta + off, -30, 30))
                    values, at = np.unique(y, return_inverse=True)
                    for k, lr in enumerate(grid):
                        r = math.exp(lr)
                        gammas = np.array([math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) for v in values])
                        total[k] += np.sum(gammas[at] - r * np.log1p(mu / r) + y * (np.log(np.maximum(mu, 1e-300)) - np.log(r + mu)))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], names=["i", "v"])

        found = {x.i: x.v for x in whole_rows(rows).select("y", "x", F.coalesce("off", F.lit(0.0)).alias("off")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        ll = np.array([found[i] for i in range(len(grid))])
        best = int(ll.argmax())
        low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    return float(math.exp(grid[best]))


def em_glm(rows: DataFrame, wr: np.ndarray, family: str, prior: Prior = Prior(), beta: np.ndarray | None = None, sigma2: float = 1.0, r: float = 10.0, r_fixed: bool = False, max_iter: int = 200, tol: float = 1e-7, firth: bool = False, vectors: np.ndarray | None = None) -> Fit:
    """Bernoulli, Poisson or negative-binomial response on wide rows (y, x, off), one aggregate an iteration.

    Persist ``rows`` before.  ``firth`` (Bernoulli only) adds the leverage term
    of Firth's penalised score, at a second pass an iteration.  ``vectors`` are
    the leading right singular vectors of a rank-l design (``right_vectors``).
    """
    fam, p1 = Family(family), len(wr) + 1
    beta = np.zeros(p1) if beta is None else beta
    for it in range(1, max_iter + 1):
        theta = theta_local(beta[1:], sigma2, prior, wr)
        prec = precisions(theta, prior.kappa)
        sigma2 = float((0.5 * np.sum(beta**2 * prec) + prior.lam) / (p1 / 2 + prior.nu + 1))
        if family == "negbin" and not r_fixed:
            r = negbin_r(rows, beta)
        gram, v, _ = weighted_rows(rows, beta, lambda eta, y, off, r=r: fam.step(eta, y, off, r), vectors)
        m = gram + np.diag(prec / sigma2)
        if firth:
            v = v + firth_term(rows, beta, np.linalg.inv(m))
        new = np.linalg.solve(m, v)
        moved, beta = _moved(new, beta), new
        if moved < tol:
            break
    ppl = weighted_rows(rows, beta, lambda eta, y, off: fam.step(eta, y, off, r))[2]
    return Fit(beta, sigma2, theta_local(beta[1:], sigma2, prior, wr), it, r=r if family == "negbin" else None, ppl=ppl)


def firth_term(rows: DataFrame, beta: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """X'(h (1/2 - mu)) with leverages h held within 0..1."""

    def link_x(batches):
        total = np.zeros(len(beta))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), matrix(b.column(0))])
                mu = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
                h = np.clip(np.maximum(mu * (1 - mu), 1e-6) * np.einsum("ij,jk,ik->i", x, inverse, x), 0, 1)
                total += x.T @ (h * (0.5 - mu))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    found = {r.i: r.v for r in rows.select("x").mapInArrow(link_x, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return np.array([found[i] for i in range(len(beta))])


def take_features(rows: DataFrame, idx: np.ndarray) -> DataFrame:
    """Wide rows with only these features, in this order."""
    at = F.array(*[F.lit(int(i)) for i in idx])
    return rows.withColumn("x", F.transform(at, lambda i: F.element_at("x", i + 1)))


def em_filter(fit, p: int, null_ppl: float, filter_frac: float = 0.25, min_features: int = 10, max_outer: int = 200, patience: int = 3, score=None) -> Fit:
    """Fit, drop the share of features with the lowest theta, fit again; the step with the least loss wins.

    ``fit(idx, warm)`` fits a subset from the last fit (or None); ``score(idx,
    fitted)``, if given, is a held-out loss to choose by instead of the fit's.
    Stops after ``patience`` rounds without a new best, at ``min_features`` or
    when nothing would remain.  Ties in theta go by position.
    """
    idx, warm, best, bad, history = np.arange(p), None, None, 0, []
    for _ in range(max_outer):
        fitted = fit(idx, warm)
        loss = score(idx, fitted) if score else fitted.ppl
        history.append({"n_features": len(idx), "ppl": fitted.ppl, "loss": loss, "null_ppl": null_ppl})
        if best is None or loss < best[0]:
            best, bad = (loss, replace(fitted, retained=idx.copy())), 0
        else:
            bad += 1
        if bad >= patience or len(idx) <= min_features:
            break
        k = max(1, math.ceil(filter_frac * len(idx)))
        if k >= len(idx):
            break
        keep = np.sort(np.lexsort((np.arange(len(idx)), fitted.theta))[k:])
        warm = replace(fitted, beta=fitted.beta[np.concatenate([[0], 1 + keep])])
        idx = idx[keep]
    out = best[1]
    out.history = history
    return out


def em_filter_gaussian(m: Moments, wr: np.ndarray, prior: Prior = Prior(), tau: float | None = None, folds: dict[int, Moments] | None = None, **how) -> Fit:
    """Elimination on moments alone; with ``folds`` (moments by fold) steps are chosen by held-out loss."""
    var = m.yty / m.n - (m.xty[0] / m.n) ** 2

    def fit(idx, warm):
        start = {"beta": warm.beta, "sigma2": warm.sigma2, "sigma_y2": warm.sigma_y2} if warm else {"sigma_y2": max(var, 1e-12)}
        return em_gaussian(m.take(idx), wr[idx], prior, tau=tau, **start)

    def held_out(idx, fitted):
        loss = 0.0
        for part in folds.values():
            f = em_gaussian(m.minus(part).take(idx), wr[idx], prior, tau=tau, beta=fitted.beta, sigma2=fitted.sigma2, sigma_y2=fitted.sigma_y2)
            loss += part.take(idx).ssr(f.beta) + part.n * f.sigma_y2
        return loss

    return em_filter(fit, len(wr), 2 * m.n * var, score=held_out if folds else None, **how)


def em_filter_glm(rows: DataFrame, wr: np.ndarray, family: str, prior: Prior = Prior(), r: float = 10.0, folds: str | None = None, n_folds: int = 5, **how) -> Fit:
    """Elimination for the other families; ``folds`` names a column of fold numbers for a held-out choice."""
    s = rows.agg(F.avg("y").alias("m"), F.sum((F.col("y") - F.lit(0)) * F.col("y")).alias("yy"), F.count("*").alias("n")).first()
    var = {"bernoulli": s.m * (1 - s.m), "poisson": s.m, "negbin": s.m + s.m**2 / r}[family]
    null = s.yy - s.n * s.m**2 + s.n * var

    def fit(idx, warm):
        start = {"beta": warm.beta, "sigma2": warm.sigma2, "r": warm.r or r} if warm else {"r": r}
        return em_glm(take_features(rows, idx), wr[idx], family, prior, **start)

    def held_out(idx, fitted):
        loss, sub = 0.0, take_features(rows, idx)
        for k in range(n_folds):
            f = em_glm(sub.where(F.col(folds) != k), wr[idx], family, prior, beta=fitted.beta, sigma2=fitted.sigma2, r=fitted.r or r)
            loss += weighted_rows(sub.where(F.col(folds) == k), f.beta, lambda eta, y, off, f=f: Family(family).step(eta, y, off, f.r or r))[2]
        return loss

    return em_filter(fit, len(wr), null, score=held_out if folds else None, **how)


def em_filter_sumstats(r: np.ndarray, bhat: np.ndarray, n: float, wr: np.ndarray, prior: Prior = Prior(), y_var: float = 1.0, block_id: np.ndarray | None = None, zeta: float = 0.7, **how) -> tuple[Fit, list[int]]:
    """Elimination from summary statistics, and the blocks that keep a feature (components of 1 - |R| <= zeta by default)."""
    m = from_summary(r, bhat, n, y_var)
    out = em_filter(lambda idx, warm: em_gaussian(m.take(idx), wr[idx], prior, **({"beta": warm.beta, "sigma2": warm.sigma2, "sigma_y2": warm.sigma_y2} if warm else {"sigma_y2": y_var})), len(wr), 2 * n * y_var, **how)
    if block_id is None:
        block_id = np.arange(len(wr))
        for i, j in zip(*np.nonzero(1 - np.abs(r) <= zeta), strict=True):
            block_id[block_id == max(block_id[i], block_id[j])] = min(block_id[i], block_id[j])
    return out, sorted({int(b) for b in np.asarray(block_id)[out.retained]})


def fit_gaussian(rows: DataFrame, wr: np.ndarray, prior: Prior = Prior(), **how) -> Fit:
    """Gaussian response on wide rows: one pass, then the core."""
    return em_gaussian(moments(rows), wr, prior, **how)
