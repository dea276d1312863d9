"""Validation: folds, cross-validation, bootstrap, interval coverage, reliability, prediction intervals."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkslab.functions.exprs import clipped_exp, held
from sparkslab.operators.suffstats import Moments, matrix, whole_rows


def with_folds(df: DataFrame, k: int, seed: int = 0, stratify: str | None = None, order: str | None = None) -> DataFrame:
    """``df`` with fold in 0..k-1: by a hash of the row's columns, within classes, or in contiguous pieces of ``order``.

    Classes are dealt round robin inside hash buckets, so a large class is not one window.
    """
    if order:
        ends = df.agg(*[F.percentile_approx(order, [(i + 1) / k for i in range(k - 1)], 10_000).alias("q")]).first().q
        return df.withColumn("fold", sum((F.when(F.col(order) > e, 1).otherwise(0) for e in ends), F.lit(0)))
    h = F.xxhash64(*[F.col(c) for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")], F.lit(seed))
    if not stratify:
        return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    keyed = df.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(256)))
    n = F.row_number().over(Window.partitionBy(stratify, "_b").orderBy("_h"))
    return keyed.withColumn("fold", F.pmod(n + F.col("_b"), F.lit(k)).cast("int")).drop("_h", "_b")


def ridge_by_fold(folds: dict[int, Moments], ridge: float = 1.0) -> dict[int, np.ndarray]:
    """Coefficients without each fold's rows, from moments by fold."""
    total = Moments(*(sum(getattr(f, a) for f in folds.values()) for a in ("n", "gram", "xty", "yty")))
    out = {}
    for k, part in folds.items():
        m = total.minus(part)
        out[k] = np.linalg.solve(m.gram + ridge * np.eye(len(m.xty)), m.xty)
    return out


def linear(x: Column, beta: np.ndarray) -> Column:
    """Intercept plus inner product with the coefficients."""
    return sum((F.element_at(x, k + 1) * float(b) for k, b in enumerate(beta[1:])), F.lit(float(beta[0])))


def cross_val_predict(rows: DataFrame, fits: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (with fold and x) with prediction from the fit that didn't see them."""
    p = F.lit(None).cast("double")
    for k, beta in fits.items():
        p = F.when(F.col("fold") == k, linear(F.col("x"), beta)).otherwise(p)
    return rows.withColumn("prediction", p)


def r2_by_fold(predicted: DataFrame) -> DataFrame:
    """(fold, score): 1 - residual over total sum of squares, null if the latter is 0."""
    s = predicted.groupBy("fold").agg(F.sum((F.col("y") - F.col("prediction")) ** 2).alias("res"), (F.var_pop("y") * F.count("*")).alias("tot"))
    return s.select("fold", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).alias("score"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """(score): share of rows on the right side of one half."""
    return predicted.agg(F.avg(((F.col("prediction") >= 0.5).cast("double") == F.col("y")).cast("double")).alias("score"))


def cross_validate(rows: DataFrame, fit: Callable[[DataFrame], Callable[[Column], Column]], k: int = 5, scoring: Callable[[DataFrame], float] | None = None, **how) -> list[float]:
    """Scores of ``fit(training rows) -> predictor`` on each fold's rows."""
    folded = with_folds(rows, k, **how).persist()
    scores = []
    for i in range(k):
        predictor = fit(folded.where(F.col("fold") != i))
        held = folded.where(F.col("fold") == i).withColumn("prediction", predictor(F.col("x")))
        scores.append(scoring(held) if scoring else r2_by_fold(held).first().score)
    folded.unpersist()
    return scores


#: P(Poisson(1) <= k), and products of row values in memory at once.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_AT_ONCE = 1 << 22


def resample_weights(ids: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (rows by resamples), each from a mix of the row's whole id, the resample's number and the seed."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(n_boot, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x8CB92BA72F3D8DD7))
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
        h ^= h >> np.uint64(31)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) * 2.0**-53, side="right").astype(float)


def bootstrap_moments(rows: DataFrame, n_boot: int, seed: int = 0) -> list[Moments]:
    """Moments of ``n_boot`` Poisson(1) resamples of wide rows (row_id, y, x), all from one pass.

    A row's weights come from its row_id and the seed, so results don't depend
    on partitions, and rows with unlike ids have unlike weights.  Rows with a
    null id, y, x or element of x are left out.  (Poisson weights vary
    the sample's size.)
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                ids, y, x = np.asarray(b.column(0)), np.asarray(b.column(1), float), matrix(b.column(2))
                z = np.column_stack([np.ones(len(y)), x, y])
                p = z.shape[1]
                step = max(1, _AT_ONCE // max(p * p, n_boot))
                for i in range(0, len(z), step):
                    some = z[i : i + step]
                    part = (resample_weights(ids[i : i + step], n_boot, seed).T @ (some[:, :, None] * some[:, None, :]).reshape(len(some), p * p)).ravel()
                    total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    found = {r.i: r.v for r in whole_rows(rows.where("row_id is not null")).select("row_id", "y", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([found[i] for i in range(len(found))]).reshape(n_boot, -1)
    p = int(np.sqrt(flat.shape[1]))
    return [Moments(z[0, 0], z[:-1, :-1], z[:-1, -1], float(z[-1, -1])) for z in flat.reshape(n_boot, p, p)]


def bootstrap_ci(rows: DataFrame, fit: Callable[[Moments], np.ndarray], n_boot: int = 200, ci: float = 0.95, seed: int = 0) -> dict[str, np.ndarray]:
    """Percentile intervals of the coefficients ``fit`` makes of resampled moments; failed fits are counted."""
    draws, failed = [], 0
    for m in bootstrap_moments(rows, n_boot, seed):
        try:
            draws.append(fit(m))
        except np.linalg.LinAlgError:
            failed += 1
    return intervals(np.array(draws), ci, failed)


def intervals(draws: np.ndarray, ci: float = 0.95, failed: int = 0) -> dict[str, np.ndarray]:
    """Percentile intervals, means and deviations of draws, one row each; rows with a nan count as failed."""
    d = draws[np.isfinite(draws).all(1)]
    failed += len(draws) - len(d)
    return {"lo": np.percentile(d, 50 * (1 - ci), axis=0), "hi": np.percentile(d, 50 * (1 + ci), axis=0), "mean": d.mean(0), "std": d.std(0), "failed": np.array(failed)}


def coverage(intervals: DataFrame) -> DataFrame:
    """(grp, coverage, n, mean_width) of (beta_true, lo, hi): causal, null and overall at once."""
    inside = ((F.col("beta_true") >= F.col("lo")) & (F.col("beta_true") <= F.col("hi"))).cast("double")
    kind = intervals.withColumn("kind", F.when(F.col("beta_true") != 0, "causal").otherwise("null"))
    return kind.rollup("kind").agg(F.avg(inside).alias("coverage"), F.count("*").alias("n"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width")).select(F.coalesce("kind", F.lit("overall")).alias("grp"), "coverage", "n", "mean_width")


def reliability(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_theta, rate) of (theta, is_causal): bins are left-closed at the inner edges, empty ones have nulls."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, n_bins + 1)[1:-1]])
    bins = scored.withColumn("bin", F.size(F.filter(edges, lambda e: F.col("theta") >= e)))
    found = bins.groupBy("bin").agg(F.count("*").alias("n"), F.avg("theta").alias("mean_theta"), F.avg(F.col("is_causal").cast("double")).alias("rate"))
    every = scored.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_theta", "rate")


def calibration(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """(ece, brier) of (theta, is_causal)."""
    ece = reliability(scored, n_bins).where("n > 0").agg((F.sum(F.col("n") * F.abs(F.col("mean_theta") - F.col("rate"))) / F.sum("n")).alias("ece"))
    brier = scored.agg(F.avg((F.col("theta") - F.col("is_causal").cast("double")) ** 2).alias("brier"))
    return ece.join(F.broadcast(brier))


def replicate(spark, fit: Callable[[np.random.Generator], list[tuple]], schema: str, n_reps: int = 200, seed: int = 0) -> DataFrame:
    """Rows of ``fit(rng)`` for each replicate, with its number as rep; replicates run in parallel."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                out = pd.DataFrame(fit(np.random.default_rng([seed, int(k)])), columns=names)
                out.insert(0, "rep", int(k))
                yield out

    return spark.range(n_reps).repartition(min(n_reps, spark.sparkContext.defaultParallelism)).mapInPandas(run, f"rep long, {schema}")


def eta_sd(x: Column, cov: np.ndarray) -> Column:
    """Standard deviation of the linear predictor, sqrt(x' C x), as a native expression."""
    one = F.concat(F.array(F.lit(1.0)), x)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in cov])
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
    return F.sqrt(held(inner(one, F.transform(rows, lambda r: inner(r, one))), 0.0))


def predict_interval(rows: DataFrame, beta: np.ndarray, cov: np.ndarray, link: str = "identity", ci: float = 0.95, points: int = 20) -> DataFrame:
    """``rows`` with mean, std, lower, upper of the response.

    Links are monotone, so the interval's ends are the link of eta -+ z sd; the
    deviation is by Gauss-Hermite quadrature, with no random numbers.
    """
    z = NormalDist().inv_cdf((1 + ci) / 2)
    g = {"identity": lambda e: e, "logit": lambda e: 1 / (1 + F.exp(-e)), "log": clipped_exp}[link]
    out = rows.withColumn("_eta", linear(F.col("x"), beta)).withColumn("_sd", eta_sd(F.col("x"), cov))
    nodes, weights = np.polynomial.hermite_e.hermegauss(points)
    weights = weights / weights.sum()
    at = [g(F.col("_eta") + float(t) * F.col("_sd")) for t in nodes]
    first = sum((float(w) * v for w, v in zip(weights, at, strict=True)), F.lit(0.0))
    second = sum((float(w) * v * v for w, v in zip(weights, at, strict=True)), F.lit(0.0))
    return out.select(*rows.columns, g(F.col("_eta")).alias("mean"), F.sqrt(held(second - first * first, 0.0)).alias("std"), g(F.col("_eta") - z * F.col("_sd")).alias("lower"), g(F.col("_eta") + z * F.col("_sd")).alias("upper"))
