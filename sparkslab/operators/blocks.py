"""Blocks of features: extents merged, gaps and islands, components, clusters, and what is said of each block."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkslab.operators.components import connected_components
from sparkslab.operators.factor import covariance as covariance_of
from sparkslab.operators.suffstats import Moments
from sparkslab.operators.sweep import gaps, running


def merge_extents(extents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(start, end, relevance) between neighbouring ends of the extents (l, r, relevance), optionally for each ``by``.

    A piece is covered by the extents with l <= middle < r and has their mean
    relevance, 0 if there is none.
    """
    by = by or []
    # what begins and ends at each end: running sums over the ends are what covers the piece behind it
    covers = F.col("l") < F.col("r")
    weight, one = F.when(covers, F.coalesce("relevance", F.lit(0.0))).otherwise(0.0), F.when(covers & F.col("relevance").isNotNull(), 1).otherwise(0)
    marks = extents.select(*by, F.col("l").alias("start"), weight.alias("w"), one.alias("c")).unionByName(extents.select(*by, F.col("r").alias("start"), (-weight).alias("w"), (-one).alias("c")))
    ends = marks.where("start is not null").groupBy(*by, "start").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    pieces = running(ends, "start", {"total": F.col("w"), "n": F.col("c")}, by, following="end").where("end is not null")
    return pieces.select(*by, "start", "end", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("relevance"))


def threshold_blocks(features: DataFrame, zeta, coord: str = "s", by: list[str] | None = None) -> DataFrame:
    """``features`` with block_id: a new block begins at each gap of zeta or more, in order of place.

    ``zeta`` is a number or a column; null places come first in a block of their own.
    """
    order = Window.partitionBy(*(by or [])).orderBy(coord, "feature_id")
    new = F.when(F.col(coord) - F.lag(coord).over(order) >= (zeta if not isinstance(zeta, (int, float)) else F.lit(zeta)), 1).otherwise(0)
    flagged = features.withColumn("_new", new)
    return flagged.withColumn("block_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_percentile(features: DataFrame, q: float = 0.75, coord: str = "s") -> float:
    """A percentile of the gaps between neighbouring places."""
    return float(gaps(features, coord).agg(F.percentile("gap", q)).first()[0] or 0.0)


def graph_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature_id, block_id): components, numbered densely by their smallest member; a node without edges is one."""
    parts = connected_components(edges)
    named = nodes.select("feature_id").join(parts.withColumnRenamed("node", "feature_id"), "feature_id", "left").withColumn("component", F.coalesce("component", "feature_id"))
    # one row a component, so the numbering's window sees blocks, not features
    numbers = named.select("component").distinct().select("component", (F.row_number().over(Window.orderBy("component")) - 1).alias("block_id"))
    return named.join(numbers, "component").select("feature_id", "block_id")


def distance_blocks(nodes: DataFrame, distances: DataFrame, zeta: float) -> DataFrame:
    """Components of edges with 0 < d <= zeta."""
    return graph_blocks(nodes, distances.where((F.col("d") > 0) & (F.col("d") <= zeta)))


def correlation_blocks(nodes: DataFrame, correlations: DataFrame, rho: float = 0.3) -> DataFrame:
    """Components of pairs (i, j, r) with |r| >= rho."""
    return graph_blocks(nodes, correlations.where((F.abs("r") >= rho) & (F.col("i") != F.col("j"))).select(F.col("i").alias("src"), F.col("j").alias("dst")))


def kmeans_blocks(features: DataFrame, per_block: int = 8, n_blocks: int | None = None, seed: int = 0) -> DataFrame:
    """(feature_id, block_id) by k-means on the coord arrays, with max(2, features / per_block) clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = n_blocks or max(2, features.count() // per_block)
    rows = features.select("feature_id", array_to_vector(F.transform("coord", lambda v: v.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("feature_id", F.col("prediction").alias("block_id"))


def graphical_lasso(s: np.ndarray, alpha: float, max_iter: int = 100, tol: float = 1e-4, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sparse precision matrix of covariance ``s`` by block coordinate descent (driver side: p by p), and where it ended, to start the next alpha from.

    The diagonal isn't penalised.
    """
    p = len(s)
    if start is None:
        w, b = 0.95 * s, np.zeros((p, p))
    else:
        w, b = start[0].copy(), start[1].copy()
    np.fill_diagonal(w, np.diag(s))
    scale = np.abs(s - np.diag(np.diag(s))).mean() if p > 1 else 0.0
    for _ in range(max_iter if p > 1 else 0):
        before = w.copy()
        for j in range(p):
            rest = np.flatnonzero(np.arange(p) != j)
            v, x = w[np.ix_(rest, rest)], b[rest, j].copy()
            left, own = s[rest, j] - v @ x, np.diag(v)
            for _ in range(50):
                moved = 0.0
                for k in range(p - 1):
                    r = left[k] + own[k] * x[k]
                    new = (r - alpha if r > alpha else r + alpha if r < -alpha else 0.0) / own[k]
                    if new != x[k]:
                        step = new - x[k]
                        left -= v[k] * step
                        x[k], moved = new, max(moved, abs(step))
                if moved < 1e-6:
                    break
            b[rest, j] = x
            w[rest, j] = w[j, rest] = v @ x
        if np.abs(w - before).mean() < tol * scale + 1e-12:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        theta[j, j] = 1 / max(w[j, j] - w[rest, j] @ b[rest, j], 1e-12)
        theta[rest, j] = -b[rest, j] * theta[j, j]
    return (theta + theta.T) / 2, (w, b)


def _fold_losses(train: np.ndarray, test: np.ndarray, alphas: list[float]) -> list[float]:
    """Minus the held-out Gaussian log-likelihood (twice, by row) along falling alphas, each started from the one before."""
    out, at = [], None
    for alpha in alphas:
        theta, at = graphical_lasso(train, alpha, start=at)
        sign, logdet = np.linalg.slogdet(theta)
        out.append(float(np.sum(test * theta) - logdet) if sign > 0 else math.inf)
    return out


def glasso_alpha(spark: SparkSession, folds: dict[int, Moments], rounds: int = 3, width: int = 6) -> float:
    """The penalty with the least held-out loss, of the standardised features' moments by fold (``moments(rows, by=fold)``: one pass over the rows).

    Alphas fall geometrically from the least that leaves no edge; each round
    narrows to the best one's neighbours.  Folds go side by side, one small task
    each, on p-by-p matrices.
    """
    whole = functools.reduce(lambda a, b: a.minus(Moments(-b.n, -b.gram, -b.xty, -b.yty)), folds.values())
    _, cov = covariance_of(whole)
    sd = np.sqrt(np.diag(cov)) + 1e-8
    pairs = [(covariance_of(whole.minus(part))[1] / np.outer(sd, sd), covariance_of(part)[1] / np.outer(sd, sd)) for part in folds.values()]
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    high = float(r.max()) or 1.0
    low = 0.01 * high
    alphas: list[float] = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [_fold_losses(*pairs[int(k)], alphas) for k in pdf["id"]]})

    for _ in range(rounds):
        alphas = np.geomspace(high, low, width).tolist()
        found = spark.range(len(pairs)).groupBy("id").applyInPandas(run, "v array<double>").collect()
        loss = np.sum([x.v for x in found], axis=0)
        best = int(np.argmin(loss))
        high, low = alphas[max(0, best - 1)], alphas[min(width - 1, best + 1)]
    return alphas[best]


def glasso_blocks(nodes: DataFrame, covariance: np.ndarray, alpha: float, max_features: int = 200) -> DataFrame:
    """Components of the non-zero entries (above 1e-8) of the graphical lasso's precision matrix."""
    if len(covariance) > max_features:
        raise ValueError(f"{len(covariance)} features; graphical lasso takes at most {max_features}")
    precision = graphical_lasso(covariance, alpha)[0]
    linked = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.abs(precision) > 1e-8), strict=True) if i < j]
    return graph_blocks(nodes, nodes.sparkSession.createDataFrame(linked, "src long, dst long"))


def determine_blocks(nodes: DataFrame, method: str = "threshold", zeta: float | None = None, percentile: float = 0.75, correlations: DataFrame | None = None, distances: DataFrame | None = None, rho: float = 0.3, covariance: np.ndarray | None = None, alpha: float | str = 0.1, folds: dict[int, Moments] | None = None, **kmeans) -> DataFrame:
    """(feature_id, block_id) by the method named; zeta defaults to a percentile of gaps or distances, ``alpha="cv"`` chooses by the moments of ``folds``."""
    if method == "threshold" and distances is not None:
        return distance_blocks(nodes, distances, zeta if zeta is not None else float(distances.where("d > 0").agg(F.percentile("d", percentile)).first()[0]))
    if method == "threshold":
        return threshold_blocks(nodes, zeta if zeta is not None else gap_percentile(nodes, percentile)).select("feature_id", "block_id")
    if method == "correlation":
        return correlation_blocks(nodes, correlations, rho)
    if method == "glasso":
        if alpha == "cv":
            if not folds or len(folds) < 2:
                raise ValueError("a cross-validated penalty needs the moments of two folds or more")
            alpha = glasso_alpha(nodes.sparkSession, folds)
        return glasso_blocks(nodes, covariance, alpha)
    if method == "kmeans":
        return kmeans_blocks(nodes, **kmeans)
    raise ValueError(f"unknown block method {method!r}")


def members(blocks: DataFrame) -> DataFrame:
    """(block_id, members): each block's feature ids in order."""
    return blocks.groupBy("block_id").agg(F.sort_array(F.collect_list("feature_id")).alias("members"))


def summarize(fits: DataFrame) -> DataFrame:
    """For each block of (feature_id, block_id, theta, beta): best feature, its theta and beta, mean |beta|, size; ties go to the lowest id."""
    best = F.max_by(F.struct("feature_id", "theta", "beta"), F.struct("theta", -F.col("feature_id")))
    return fits.groupBy("block_id").agg(best.alias("b"), F.avg(F.abs("beta")).alias("mean_abs_beta"), F.count("*").alias("n")).select("block_id", F.col("b.feature_id").alias("top_feature"), F.col("b.theta").alias("top_theta"), F.col("b.beta").alias("top_beta"), "mean_abs_beta", "n")
