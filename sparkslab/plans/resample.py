"""Whole-pipeline resampling beyond moments: reweighted fits of all resamples at once, and moving blocks of time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.operators.suffstats import Moments, matrix, whole_rows
from sparkslab.plans import dynamic, em
from sparkslab.plans.validate import resample_weights


def em_glm_resampled(rows: DataFrame, wr: np.ndarray, family: str, prior: em.Prior = em.Prior(), n_boot: int = 200, seed: int = 0, r: float = 10.0, maps: list[np.ndarray] | None = None, max_iter: int = 200, tol: float = 1e-7) -> np.ndarray:
    """Coefficients (resamples by 1 + features) of ``em.em_glm`` on Poisson(1) resamples of wide rows (row_id, y, x, off).

    All resamples that aren't settled advance in one aggregate an iteration:
    tasks send one sum for each, and its update is made where these meet, so
    that only coefficients reach the driver.  ``maps`` takes [1, x] to each
    resample's own design.  A negative-binomial dispersion stays ``r``.  A
    singular resample is nan.  Rows with a null id, y, x or element of x are
    left out, a null offset is 0.
    """
    fam, k = em.Family(family), len(wr) + 1
    rows = whole_rows(rows.where("row_id is not null")).select("row_id", F.col("y").cast("double"), "x", F.coalesce("off", F.lit(0.0)).alias("off")).persist()
    beta, sigma2, open_ = np.zeros((n_boot, k)), np.ones(n_boot), list(range(n_boot))

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                ids, y, x, off = np.asarray(batch.column(0)), np.asarray(batch.column(1), float), matrix(batch.column(2)), np.asarray(batch.column(3), float)
                one, times = np.column_stack([np.ones(len(y)), x]), resample_weights(ids, n_boot, seed)
                for b in open_:
                    some = times[:, b] > 0
                    d = one[some] if maps is None else one[some] @ maps[b].T
                    w, wz, _ = fam.step(d @ beta[b], y[some], off[some], r)
                    part = np.concatenate([((d * (w * times[some, b])[:, None]).T @ d).ravel(), d.T @ (wz * times[some, b])])
                    total[b] = part if b not in total else total[b] + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["b", "v"])

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        b, v = int(pdf["b"].iloc[0]), np.sum(np.stack(pdf["v"].to_numpy()), axis=0)
        prec = em.precisions(em.theta_local(beta[b, 1:], sigma2[b], prior, wr), prior.kappa)
        s = float((0.5 * np.sum(beta[b] ** 2 * prec) + prior.lam) / (k / 2 + prior.nu + 1))
        try:
            new = np.linalg.solve(v[: k * k].reshape(k, k) + np.diag(prec / s), v[k * k :])
        except np.linalg.LinAlgError:
            new = np.full(k, np.nan)
        moved = float(np.linalg.norm(new - beta[b]) / (np.linalg.norm(beta[b]) + 1e-12))
        return pd.DataFrame({"b": [b], "beta": [new], "s": [s], "settled": [not moved >= tol]})

    for _ in range(max_iter):
        found = rows.mapInArrow(sums, "b int, v array<double>").groupBy("b").applyInPandas(update, "b int, beta array<double>, s double, settled boolean").collect()
        for x in found:
            beta[x.b], sigma2[x.b] = x.beta, x.s
        open_ = sorted(x.b for x in found if not x.settled)
        if not open_:
            break
    rows.unpersist()
    return beta


def moving_blocks(steps: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Places of a resampled trajectory: blocks of ``length`` consecutive steps, from anywhere, to the same number."""
    length = min(max(length, 1), steps)
    starts = rng.integers(0, steps - length + 1, math.ceil(steps / length))
    return (starts[:, None] + np.arange(length)).ravel()[:steps]


def dynamic_resampled(spark, x: np.ndarray, y: np.ndarray, owner: np.ndarray, coupling: np.ndarray | None, fit, n_boot: int = 200, seed: int = 0, length: int | None = None) -> np.ndarray:
    """What ``fit`` makes of each moving-block resample's moments, with its dynamic factors fitted anew; one small task a resample.

    x and y are a trajectory of bounded length, in order, and go to every task.
    """
    data, length = spark.sparkContext.broadcast((x, y)), length or max(2, round(len(y) ** (1 / 3)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = data.value
        out = []
        for b in pdf["id"]:
            at = moving_blocks(len(y), length, np.random.default_rng([seed, int(b)]))
            fits = [dynamic.fit_dynamic(x[at], owner, coupling)] if coupling is not None else [dynamic.fit_dynamic(x[at][:, owner == c]) for c in np.unique(owner)]
            d = np.column_stack([np.ones(len(at)), *[f.z for f in fits]])
            try:
                out.append((b, fit(Moments(len(at), d.T @ d, d.T @ y[at], float(y[at] @ y[at])))))
            except np.linalg.LinAlgError:
                out.append((b, np.full(d.shape[1], np.nan)))
        return pd.DataFrame(out, columns=["b", "beta"])

    found = spark.range(n_boot).groupBy("id").applyInPandas(run, "b long, beta array<double>").collect()
    data.unpersist()
    return np.array([x.beta for x in sorted(found, key=lambda x: x.b)])
