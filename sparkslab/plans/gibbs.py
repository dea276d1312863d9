"""Gibbs samplers: on moments for a Gaussian response, on rows with Polya-Gamma variables for the others."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.functions.linalg import EigenSurrogate, effective_rank, exact_draw, polya_gamma, woodbury_draw
from sparkslab.operators.suffstats import Moments, from_summary, matrix, moments, right_vectors, whole_rows
from sparkslab.plans.em import Prior, negbin_r, precisions, theta_local


@dataclass
class Draws:
    """Posterior draws, one row each."""

    beta: np.ndarray
    theta: np.ndarray
    sigma2: np.ndarray
    sigma_y2: np.ndarray | None = None
    r: np.ndarray | None = None

    @property
    def pi(self) -> np.ndarray:
        """Marginal inclusion probabilities."""
        return self.theta.mean(0)


def _sweep(beta, theta, prior, wr, rng):
    """Draws of sigma2, then theta, given beta."""
    prec = precisions(theta, prior.kappa)
    sigma2 = 1 / rng.gamma(prior.nu + len(beta) / 2, 1 / (prior.lam + 0.5 * np.sum(beta**2 * prec)))
    return sigma2, (rng.random(len(theta)) < theta_local(beta[1:], sigma2, prior, wr)).astype(float)


def gibbs_gaussian(m: Moments, wr: np.ndarray, prior: Prior = Prior(), n_samples: int = 2000, burn_in: int = 500, thin: int = 1, seed: int | None = None, rank: int | None = None) -> Draws:
    """Conjugate sampler on the driver, whatever the number of rows.

    With ``rank`` the design is its leading l right singular vectors' part, and
    a draw solves an l-by-l system instead of a p-by-p one.
    """
    rng, s = np.random.default_rng(seed), None
    if rank:
        v = right_vectors(m, rank)
        s = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", v, m.gram, v), 0))[:, None] * v.T
        m = Moments(m.n, s.T @ s, v @ (v.T @ m.xty), m.yty)  # X'y is that of the same part, or what is left of it would have no end
    beta, theta, kept = np.zeros(len(m.xty)), np.ones(len(wr)), []
    for it in range(burn_in + n_samples * thin):
        sigma2, theta = _sweep(beta, theta, prior, wr, rng)
        sigma_y2 = 1 / rng.gamma(prior.nu_y + m.n / 2, 1 / (prior.lam_y + 0.5 * m.ssr(beta)))
        scale = sigma2 / precisions(theta, prior.kappa)
        beta = (exact_draw(m.gram / sigma_y2, scale, m.xty / sigma_y2, rng) if s is None else woodbury_draw(s / math.sqrt(sigma_y2), scale, m.xty / sigma_y2, rng))[1]
        if it >= burn_in and (it - burn_in) % thin == 0:
            kept.append((beta, theta, sigma2, sigma_y2))
    return Draws(*[np.array(x) for x in zip(*kept, strict=True)])


def gibbs_sumstats(r: np.ndarray, bhat: np.ndarray, n: float, wr: np.ndarray, prior: Prior = Prior(), y_var: float = 1.0, rank: int | str | None = None, **how) -> Draws:
    """The same from summary statistics; ``rank`` is that of the correlations, ``"auto"`` their numerical one."""
    if rank is None:
        return gibbs_gaussian(from_summary(r, bhat, n, y_var), wr, prior, **how)
    kept = EigenSurrogate(np.asarray(r, float), effective_rank(r) if rank == "auto" else int(rank))
    return gibbs_gaussian(from_summary(kept.matrix(), kept.project(np.asarray(bhat, float)), n, y_var), wr, prior, rank=len(kept.e) + 1, **how)


def gibbs_chains(spark, m: Moments, wr: np.ndarray, prior: Prior = Prior(), chains: int = 4, seed: int = 0, **how) -> DataFrame:
    """(chain, draw, beta, theta) of independent Gaussian chains, one task each."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.chain.iloc[0])
        d = gibbs_gaussian(m, wr, prior, seed=seed + k, **how)
        return pd.DataFrame({"chain": k, "draw": range(len(d.beta)), "beta": list(d.beta), "theta": list(d.theta)})

    return spark.range(chains).withColumnRenamed("id", "chain").groupBy("chain").applyInPandas(run, "chain long, draw long, beta array<double>, theta array<double>")


def _augmented(rows: DataFrame, beta: np.ndarray, family: str, r: float, seed: int, vectors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'(omega)X and X'(kappa terms) with omega drawn on the executors, one partial a task; with ``vectors`` those of X times them."""
    if vectors is not None:
        beta = vectors.T @ beta

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = None
        for b in batches:
            if b.num_rows:
                y, x, off = np.asarray(b.column(0), float), np.column_stack([np.ones(b.num_rows), matrix(b.column(1))]), np.asarray(b.column(2), float)
                x = x if vectors is None else x @ vectors
                if family == "bernoulli":
                    shift, shape, centre = 0.0, 1.0, y - 0.5
                else:
                    shift, shape, centre = off - math.log(r), y + r, (y - r) / 2
                omega = polya_gamma(shape, x @ beta + shift, rng)
                part = np.concatenate([((x * omega[:, None]).T @ x).ravel(), x.T @ (centre - omega * shift)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    found = {x.i: x.v for x in rows.select("y", "x", "off").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat, p = np.array([found[i] for i in range(len(found))]), len(beta)
    return flat[: p * p].reshape(p, p), flat[p * p :]


def gibbs_glm(rows: DataFrame, wr: np.ndarray, family: str = "bernoulli", prior: Prior = Prior(), n_samples: int = 2000, burn_in: int = 500, thin: int = 1, seed: int = 0, r: float = 10.0, update_r_every: int = 1, rank: int | None = None) -> Draws:
    """Bernoulli or negative-binomial response: one aggregate a sweep; persist ``rows`` before.

    With ``rank`` the design is its leading l right singular vectors' part: tasks
    send l-by-l sums, and a draw solves an l-by-l system.  Rows with a null y, x
    or element of x are left out, a null offset is 0.  A task's draws depend on the seed, sweep and partition, so a task that is
    run again draws the same.
    """
    if family not in ("bernoulli", "negbin"):
        raise ValueError(f"no Gibbs sampler for {family}")
    rng = np.random.default_rng(seed)
    rows = whole_rows(rows).withColumn("off", F.coalesce("off", F.lit(0.0)))
    v = right_vectors(moments(rows), rank) if rank else None
    beta, theta, kept = np.zeros(len(wr) + 1), np.ones(len(wr)), []
    for it in range(burn_in + n_samples * thin):
        sigma2, theta = _sweep(beta, theta, prior, wr, rng)
        gram, c = _augmented(rows, beta, family, r, seed * 1_000_003 + it, v)
        scale = sigma2 / precisions(theta, prior.kappa)
        if v is None:
            beta = exact_draw(gram, scale, c, rng)[1]
        else:
            e, u = np.linalg.eigh(gram)
            beta = woodbury_draw(np.sqrt(np.maximum(e, 0))[:, None] * (v @ u).T, scale, v @ c, rng)[1]
        if family == "negbin" and it % update_r_every == 0:
            r = negbin_r(rows, beta)
        if it >= burn_in and (it - burn_in) % thin == 0:
            kept.append((beta, theta, sigma2, r))
    b, t, s, rs = (np.array(x) for x in zip(*kept, strict=True))
    return Draws(b, t, s, r=rs if family == "negbin" else None)
