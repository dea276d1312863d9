"""Selection: false-discovery control, centroid sets, stability selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def centroid(df: DataFrame, gamma: float = 1.0, pi: str = "pi") -> DataFrame:
    """``df`` with selected: pi >= 1 / (1 + gamma)."""
    return df.withColumn("selected", F.col(pi) >= 1 / (1 + gamma))


def embfdr(df: DataFrame, gamma: float = 1.0, by: list[str] | None = None, theta: str = "theta") -> DataFrame:
    """Mean of 1 - theta over the features with theta >= 1 / (1 + gamma), 0 if there is none."""
    chosen = F.col(theta) >= 1 / (1 + gamma)
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(F.when(chosen, 1 - F.col(theta))), F.lit(0.0)).alias("embfdr"), F.count(F.when(chosen, 1)).alias("n_selected"))


def select_kappa(df: DataFrame, gammas: list[float], target: float = 0.05, gamma: float | None = None) -> tuple[float, float, DataFrame]:
    """(kappa, gamma, table) for thetas by kappa: the largest kappa whose rate meets the target, else the least rate's."""
    gammas = sorted(gammas)
    fixed = gamma if gamma is not None else float(np.median(gammas))
    grid = df.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in sorted({*gammas, fixed})])))
    chosen = F.col("theta") >= 1 / (1 + F.col("gamma"))
    rates = grid.groupBy("kappa", "gamma").agg(F.coalesce(F.avg(F.when(chosen, 1 - F.col("theta"))), F.lit(0.0)).alias("embfdr"))
    row = rates.where(F.col("gamma") == fixed).agg(F.max(F.when(F.col("embfdr") <= target, F.col("kappa"))).alias("met"), F.min_by("kappa", F.struct("embfdr", "kappa")).alias("least")).first()
    return (row.met if row.met is not None else row.least), fixed, rates


def admit(stability: DataFrame, threshold: float) -> DataFrame:
    """Features strictly above the threshold."""
    return stability.where(F.col("stability") > threshold)


def selection_quality(draws: DataFrame, by: list[str]) -> DataFrame:
    """(by, true_positives, n_selected, power, precision) of (by, selected, is_causal).

    Power is null where nothing is causal, precision where nothing is selected; a
    null flag counts as false.
    """
    chosen, causal = F.coalesce(F.col("selected").cast("int"), F.lit(0)), F.coalesce(F.col("is_causal").cast("int"), F.lit(0))
    s = draws.groupBy(*by).agg(F.sum(chosen * causal).alias("true_positives"), F.sum(chosen).alias("n_selected"), F.sum(causal).alias("_causal"))
    share = lambda n: F.when(F.col(n) > 0, F.col("true_positives") / F.col(n))
    return s.select(*by, "true_positives", "n_selected", share("_causal").alias("power"), share("n_selected").alias("precision"))


def frequencies(draws: DataFrame) -> DataFrame:
    """(feature_id, selected, candidate, stability) of (draw, feature_id, selected)."""
    s = F.sum(F.col("selected").cast("int"))
    return draws.groupBy("feature_id").agg(s.alias("selected"), F.count("*").alias("candidate"), (s / F.count("*")).alias("stability"))


def _draws(spark: SparkSession, n: int, subsets: Callable[[int], list[np.ndarray]], fit: Callable[[np.ndarray], np.ndarray], p: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                for half, idx in enumerate(subsets(int(k))):
                    chosen = np.zeros(len(idx), bool)
                    chosen[np.asarray(fit(idx), dtype=int)] = True
                    yield pd.DataFrame({"draw": 2 * k + half, "feature_id": idx, "selected": chosen})

    found = frequencies(spark.range(n).repartition(min(n, spark.sparkContext.defaultParallelism)).mapInPandas(run, "draw long, feature_id long, selected boolean"))
    every = spark.range(p).withColumnRenamed("id", "feature_id").join(found, "feature_id", "left")
    return every.select("feature_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("selected", "candidate")], F.coalesce("stability", F.lit(0.0)).alias("stability"))


def stability_select(spark: SparkSession, fit: Callable[[np.ndarray], np.ndarray], p: int, n_subsets: int = 100, frac: float = 0.5, seed: int = 0, min_subset: int = 2) -> DataFrame:
    """How often each feature is chosen by ``fit(subset) -> places in it`` among random subsets; draws run in parallel."""
    size = min(p, max(min_subset, round(p * frac)))
    return _draws(spark, n_subsets, lambda k: [np.random.default_rng([seed, k]).choice(p, size, replace=False)], fit, p)


def stability_pairs(spark: SparkSession, fit: Callable[[np.ndarray], np.ndarray], p: int, n_pairs: int = 50, seed: int = 0) -> DataFrame:
    """The same over pairs of complementary halves."""

    def halves(k: int) -> list[np.ndarray]:
        perm = np.random.default_rng([seed, k]).permutation(p)
        return [perm[: p // 2], perm[p // 2 :]]

    return _draws(spark, n_pairs, halves, fit, p)
