"""Sufficient statistics: one pass over the rows gives all that a Gaussian fit needs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """n, X'X, X'y and y'y of a design with its intercept in column 0."""

    n: float
    gram: np.ndarray
    xty: np.ndarray
    yty: float

    def take(self, idx: np.ndarray) -> Moments:
        """The same for a subset of features (numbered from 0, without the intercept)."""
        at = np.concatenate([[0], 1 + np.asarray(idx, dtype=int)])
        return Moments(self.n, self.gram[np.ix_(at, at)], self.xty[at], self.yty)

    def minus(self, other: Moments) -> Moments:
        """What is left without ``other``'s rows."""
        return Moments(self.n - other.n, self.gram - other.gram, self.xty - other.xty, self.yty - other.yty)

    def ssr(self, beta: np.ndarray) -> float:
        """Sum of squared residuals, at least 0."""
        return max(0.0, float(self.yty - 2 * beta @ self.xty + beta @ self.gram @ beta))


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow list column as a matrix."""
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(len(column), -1 if len(column) else (width or 0))


def whole_rows(rows: DataFrame) -> DataFrame:
    """The rows (y, x) without a null in y or x."""
    return rows.where(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def moments(rows: DataFrame, by: str | None = None) -> dict | Moments:
    """Moments of wide rows (y, x), or a dict of them by a small-domain column such as a fold.

    Every task adds up its batches and sends one partial matrix (per group); only
    p by p numbers reach the driver.  Rows with a null y, x or element of x are
    left out; without any other row a ValueError says so.
    """
    key = F.col(by).cast("long") if by else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                keys, y, x = np.asarray(b.column(0)), np.asarray(b.column(1), dtype=float), matrix(b.column(2))
                z = np.column_stack([np.ones(len(y)), x, y])
                for k in np.unique(keys):
                    m = z[keys == k]
                    sums[int(k)] = sums.get(int(k), 0) + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], names=["k", "z"])

    parts = whole_rows(rows).select(key.alias("k"), F.col("y"), F.col("x")).mapInArrow(run, "k long, z array<double>")
    total = parts.select("k", F.posexplode("z").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in {r.k for r in total}:
        flat = np.array([r.v for r in sorted((r for r in total if r.k == k), key=lambda r: r.i)])
        z = flat.reshape(int(np.sqrt(len(flat))), -1)
        out[k] = Moments(z[0, 0], z[:-1, :-1], z[:-1, -1], float(z[-1, -1]))
    if not out:
        raise ValueError("no row has a response and all features")
    return dict(sorted(out.items())) if by else out[0]


def from_summary(r: np.ndarray, bhat: np.ndarray, n: float, y_var: float = 1.0) -> Moments:
    """Moments of standardised features from their correlations and marginal coefficients."""
    r, bhat = np.asarray(r, dtype=float), np.asarray(bhat, dtype=float)
    if r.ndim != 2 or r.shape[0] != r.shape[1] or len(bhat) != len(r):
        raise ValueError("R must be square and bhat as long as it")
    p = len(bhat)
    gram = np.zeros((p + 1, p + 1))
    gram[0, 0], gram[1:, 1:] = n, n * r
    return Moments(n, gram, np.concatenate([[0.0], n * bhat]), n * y_var)


def right_vectors(m: Moments, rank: int) -> np.ndarray:
    """The design's leading right singular vectors (intercept included), from its Gram matrix."""
    e, v = np.linalg.eigh(m.gram)
    return v[:, np.argsort(e)[::-1][:rank]]


def truncate(m: Moments, rank: int) -> tuple[Moments, float]:
    """Moments of the rank-l design, and the relative Frobenius error of the design; X'y stays exact."""
    v = right_vectors(m, rank)
    low = v @ (v.T @ m.gram @ v) @ v.T
    lost = max(0.0, float(np.trace(m.gram) - np.trace(low)))
    return Moments(m.n, low, m.xty, m.yty), float(np.sqrt(lost / np.trace(m.gram)))


def gram_long(df: DataFrame, columns: list[str], weight=None) -> DataFrame:
    """(i, j, v): weighted sums of products of columns, each pair once, by native aggregates in one pass."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double") * w).alias(f"s{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("v")) for i, j in pairs])).alias("x")).select("x.*")


def correlations_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, r) with i < j, in one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    one = df.agg(*[F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("r")) for i, j in pairs])).alias("x")).select("x.*")


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column centred and divided by its population deviation (0 if that is 0); one pass, then a projection."""
    one = df.agg(*[f(c).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = df.join(F.broadcast(one))
    return wide.select(*[(F.when(F.col(f"_s{columns.index(c)}") > 0, (F.col(c) - F.col(f"_m{columns.index(c)}")) / F.col(f"_s{columns.index(c)}")).otherwise(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def weighted_rows(rows: DataFrame, beta: np.ndarray, link, vectors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'Wz and a summed statistic for one IRLS step.

    ``link(eta, y, off)`` gives (w, w * z, statistic) by row, in NumPy.  With
    the leading right singular ``vectors`` X'WX is that of the rank-l design,
    from l-by-l partial sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y, x, off = np.asarray(b.column(0), dtype=float), matrix(b.column(1)), np.asarray(b.column(2), dtype=float)
                x = np.column_stack([np.ones(len(y)), x])
                w, wz, stat = link(x @ beta, y, off)
                u = x if vectors is None else x @ vectors
                part = np.concatenate([((u * w[:, None]).T @ u).ravel(), x.T @ wz, [np.sum(stat)]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = whole_rows(rows).select("y", "x", F.coalesce("off", F.lit(0.0)).alias("off")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not sums:
        raise ValueError("no row has a response and all features")
    flat = np.array([r.v for r in sorted(sums, key=lambda r: r.i)])
    k = len(beta) if vectors is None else vectors.shape[1]
    gram = flat[: k * k].reshape(k, k)
    return gram if vectors is None else vectors @ gram @ vectors.T, flat[k * k : -1], float(flat[-1])
