"""Copula marginals: columns to and from the normal scale by sweeps in range buckets, not by sorting on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkslab.functions.exprs import held, lgamma, ndtr, ndtri
from sparkslab.operators.sweep import AFTER, BEFORE, group_key, neighbours, running

EPS = 1e-6
#: Counts up to which the table of their probabilities is broadcast.
BROADCAST_COUNTS = 100_000
#: Knots of all places of an array up to which every task searches them (24 MB).
BROADCAST_KNOTS = 1_000_000
#: Values of a cell, a range of one place of arrays, about; and values beyond which a cell is several tasks' work.
CELL, PART = 20_000, 100_000


def _held(u: Column) -> Column:
    return held(u, EPS, 1 - EPS)


def _counted(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, c, upto, n): how often each distinct value stands, up to it, and in all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    return running(counts, value, {"upto": F.col("c")}, by, whole={"n": "upto"})


def to_gaussian_empirical(df: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """``df`` with z (replaced if there is one): the normal score of each value's Hazen rank (ties take their highest), for each ``by``.

    Ranks come from the distinct values' counts, summed in range buckets, and
    the rows are joined back; a null value has no score.
    """
    by = by or []
    scored = _counted(df, value, by).select(group_key(by).alias("_g"), F.col(value).alias("_value"), ndtri(_held((F.col("upto") - 0.5) / F.col("n"))).alias("z"))
    keyed = df.withColumn("_g", group_key(by))
    return keyed.join(scored, (keyed["_g"] == scored["_g"]) & (keyed[value] == scored["_value"]), "left").select(*[keyed[c] for c in df.columns if c != "z"], scored["z"])


def ecdf(df: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """(by, value, u_low, u_high): the lowest and highest Hazen rank of each distinct training value."""
    by = by or []
    return _counted(df, value, by).select(*by, value, ((F.col("upto") - F.col("c") + 0.5) / F.col("n")).alias("u_low"), ((F.col("upto") - 0.5) / F.col("n")).alias("u_high"))


def interpolate(queries: DataFrame, knots: DataFrame, at: str, x: str, low: str, high: str, by: list[str] | None = None, out: str = "u") -> DataFrame:
    """``queries`` with ``out`` (replaced if there is one): linear between the neighbouring knots, held at the ends; null without knots or place.

    An exact hit and a left knot give their ``high`` value, a right knot its
    ``low``: what linear interpolation over repeated knots gives.
    """
    by = by or []
    number = lambda c, name: F.col(c).cast("double").alias(name)
    k = knots.select(*by, number(x, "x"), F.struct(number(x, "x"), number(low, "lo"), number(high, "hi")).alias("k"))
    found = neighbours(queries, at, k, by)
    place, a, b = F.col(at).cast("double"), F.col(BEFORE), F.col(AFTER)
    part = (place - a["x"]) / (b["x"] - a["x"])
    u = F.when(a.isNull(), b["lo"]).when(b.isNull() | (a["x"] == place), a["hi"]).otherwise(a["hi"] + part * (b["lo"] - a["hi"]))
    return found.select(*[F.col(f"`{c}`") for c in queries.columns if c != out], F.when(place.isNotNull(), u).alias(out))


def to_gaussian(queries: DataFrame, train: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """New values on the training sample's normal scale, as column z (replaced if there is one); null stays null."""
    return on_scale(queries, ecdf(train, value, by), value, by)


def on_scale(queries: DataFrame, knots: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """``to_gaussian`` by what ``ecdf`` gave."""
    out = interpolate(queries, knots, value, value, "u_low", "u_high", by, out="_rank")
    return out.withColumn("z", ndtri(_held(F.col("_rank")))).drop("_rank")


def _members(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature_id, v) of the arrays ``x``; nulls and nans are left out."""
    each = rows.select(*keys, F.posexplode("x").alias("feature_id", "v")).withColumn("v", F.col("v").cast("double"))
    return each.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _cuts(each: DataFrame, most: int) -> dict[int, np.ndarray]:
    """The inner ends of each place's cells of about ``CELL`` of its values v, by place; ``most`` is no less than any place's values."""
    n = math.ceil(most / CELL)
    if n < 2:
        return {}
    found = each.groupBy("feature_id").agg(F.percentile_approx("v", [k / n for k in range(1, n)], max(1_000, 16 * n)).alias("ends"))
    return {int(r.feature_id): np.array(r.ends, float) for r in found.collect()}


def _cell(place: np.ndarray, v: np.ndarray, cuts: dict[int, np.ndarray], side: str = "left") -> np.ndarray:
    """Cell of each value: the cuts of its place below it (``side`` "right": or at it)."""
    cell = np.zeros(len(v), np.int32)
    for j in np.unique(place):
        if j in cuts:
            here = place == j
            cell[here] = np.searchsorted(cuts[j], v[here], side)
    return cell


def _flat(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of arrays, and place and value of their elements; a null is nan."""
    n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    v = part.flatten().to_numpy(zero_copy_only=False).astype(float)
    return n, (np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), v


def wide_ecdf(rows: DataFrame) -> DataFrame:
    """(feature_id, v, u_low, u_high): the distribution function of each place of the arrays ``x``.

    Values are dealt by place and cell; a batch's equal ones go as one row with their number.
    """
    rows = rows.select(F.col("x").cast("array<double>").alias("x")).where("x is not null")
    known = rows.sparkSession.sparkContext.broadcast(_cuts(_members(rows), rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, place, v = _flat(b.column(0))
            for j in np.unique(place):
                here = v[place == j]
                some, c = np.unique(here[~np.isnan(here)] + 0.0, return_counts=True)
                at = np.full(len(some), j, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_cell(at, some, known.value)), pa.array(some), pa.array(c.astype(np.int64))], names=["feature_id", "_cell", "v", "c"])

    dealt = rows.mapInArrow(run, "feature_id int, _cell int, v double, c long").repartition("feature_id", "_cell")
    counts = dealt.groupBy("feature_id", "_cell", "v").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("feature_id").orderBy("_cell")
    # one row a cell
    totals = dealt.groupBy("feature_id", "_cell").agg(F.sum("c").alias("_t")).select("feature_id", "_cell", (F.sum("_t").over(order) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy("feature_id")).alias("n"))
    upto = F.col("_before") + F.sum("c").over(Window.partitionBy("feature_id", "_cell").orderBy("v"))
    summed = counts.join(F.broadcast(totals), ["feature_id", "_cell"]).withColumn("upto", upto)
    return summed.select("feature_id", "v", ((F.col("upto") - F.col("c") + 0.5) / F.col("n")).alias("u_low"), ((F.col("upto") - 0.5) / F.col("n")).alias("u_high"))


def wide_scores(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """``rows`` with the arrays ``x`` on the normal scale of ``wide_ecdf``'s sample, place by place.

    A null or nan has no score (null); a null array stays null; a place without
    knots is null.  Up to ``BROADCAST_KNOTS`` knots go to every task, and no row is
    shuffled; ``knots`` are counted first, so stage them.  More meet the values in
    ``swept_scores``.
    """
    kept = knots.select("feature_id", "v", "u_low", "u_high").limit(BROADCAST_KNOTS + 1)
    if kept.count() > BROADCAST_KNOTS:
        return swept_scores(rows, knots)
    sample = kept.toPandas().sort_values(["feature_id", "v"])
    places = {int(j): g[["v", "u_low", "u_high"]].to_numpy(float).T for j, g in sample.groupby("feature_id")}
    known = rows.sparkSession.sparkContext.broadcast(places)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            n, at, v = _flat(part)
            u = np.full(len(v), np.nan)
            for j in np.unique(at):
                if j in known.value:
                    u[at == j] = _between(v[at == j], *known.value[j])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(u))

    ranks = F.arrow_udf(run, "array<double>")(F.col("x").cast("array<double>"))
    scored = F.transform(ranks, lambda u: F.when(~F.isnan(u), ndtri(_held(u))))
    made = F.when(F.size("x") > 0, scored).otherwise(F.col("x").cast("array<double>"))
    return rows.withColumn("x", F.explode(F.array(made)))  # worked out once, however often x is used


def _between(v: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What ``interpolate`` gives, of knots in order; nan stays nan."""
    right = np.searchsorted(x, v)
    a, b = np.maximum(right - 1, 0), np.minimum(right, len(x) - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = high[a] + (v - x[a]) / (x[b] - x[a]) * (low[b] - high[a])
    u = np.where(right == 0, low[0], np.where(right == len(x), high[-1], u))
    return np.where(np.isnan(v), np.nan, np.where(x[b] == v, high[b], u))


def swept_scores(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """``wide_scores`` however many the knots are: values meet the knots of their cell, a range of their place.

    A cell of many values is several tasks' work, each with the cell's knots.  Equal
    arrays are placed once, and put together again by 128 bits of their content, so
    that equal rows need no key.
    """
    content = (F.col("x"), F.transform("x", F.isnull))  # a null alone leaves a hash as it was
    keyed = rows.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("_row"), F.xxhash64(F.lit(0), *content).alias("_ka"), F.xxhash64(F.lit(1), *content).alias("_kb"))
    spark = rows.sparkSession
    most = knots.groupBy("feature_id").count().agg(F.max("count")).first()[0] or 0
    known = spark.sparkContext.broadcast(_cuts(knots, most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at, v = _flat(b.column(0))
            width = 1 + max((len(k) for k in known.value.values()), default=0)
            c = np.bincount(at.astype(np.int64) * width + _cell(at, v, known.value))
            some = np.flatnonzero(c)
            at, cell, c = (some // width).astype(np.int32), (some % width).astype(np.int32), c[some]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cell), pa.array(c)], names=["feature_id", "_cell", "c"])

    given = rows.select(F.col("x").cast("array<double>").alias("x")).where(F.size("x") > 0)
    full = given.mapInArrow(count, "feature_id int, _cell int, c long").groupBy("feature_id", "_cell").agg(F.sum("c").alias("c")).where(F.col("c") > PART)
    # one number for each ``PART`` values at most
    parts = spark.sparkContext.broadcast({(r.feature_id, r._cell): math.ceil(r.c / PART) for r in full.collect()})

    def shares(at: np.ndarray, cell: np.ndarray) -> np.ndarray:
        n = np.ones(len(at), np.int64)
        for (j, c), k in parts.value.items():
            n[(at == j) & (cell == c)] = k
        return n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, v = _flat(b.column(2))
            ka, kb = (np.repeat(b.column(k).to_numpy(), n) for k in (0, 1))
            cell = _cell(at, v, known.value)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ka, kb, at, cell, np.mod(ka, shares(at, cell)), v)], names=["_ka", "_kb", "feature_id", "_cell", "_part", "v"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a knot at a cut is the first of the next cell, too
            at, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            cell, after = _cell(at, v, known.value), _cell(at, v, known.value, "right")
            for c, some in ((cell, np.arange(len(at))), (after, np.flatnonzero(after > cell))):
                n = shares(at[some], c[some])
                again = np.repeat(some, n)
                part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(again)).columns, pa.array(c[again]), pa.array(part)], names=["feature_id", "v", "u_low", "u_high", "_cell", "_part"])

    def place(values: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("v")
        v = values["v"].to_numpy(float)
        u = _between(v, *near[["v", "u_low", "u_high"]].to_numpy(float).T) if len(near) and len(v) else np.full(len(v), np.nan)
        return values[["_ka", "_kb", "feature_id"]].assign(u=u)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays of rows in order; the last one of a batch may go on in the next."""
        left = [np.empty(0, t) for t in (np.int64, np.int64, float)]
        for b in batches:
            left = [np.concatenate([o, b.column(k).to_numpy(zero_copy_only=False)]) for k, o in enumerate(left)]
            starts = np.flatnonzero((np.diff(left[0], prepend=left[0][:1]) != 0) | (np.diff(left[1], prepend=left[1][:1]) != 0))
            if len(starts):
                yield lists([c[: starts[-1]] for c in left], np.concatenate([[0], starts]))
                left = [c[starts[-1] :] for c in left]
        if len(left[0]):
            yield lists(left, np.array([0, len(left[0])]))

    def lists(c: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        z = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[2], from_pandas=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0][ends[:-1]]), pa.array(c[1][ends[:-1]]), z], names=["_ka", "_kb", "_z"])

    arrays = keyed.select("_ka", "_kb", F.col("_row.x").cast("array<double>").alias("x")).where(F.size("x") > 0).dropDuplicates(["_ka", "_kb"])
    each = arrays.mapInArrow(deal, "_ka long, _kb long, feature_id int, _cell int, _part long, v double")
    number = lambda c: F.col(c).cast("double").alias(c)
    near = knots.select(F.col("feature_id").cast("int").alias("feature_id"), number("v"), number("u_low"), number("u_high")).mapInArrow(spread, "feature_id int, v double, u_low double, u_high double, _cell int, _part long")
    cell = ["feature_id", "_cell", "_part"]
    placed = each.groupBy(*cell).cogroup(near.groupBy(*cell)).applyInPandas(place, "_ka long, _kb long, feature_id int, u double")
    scored = placed.select("_ka", "_kb", "feature_id", F.when(~F.isnan("u"), ndtri(_held(F.col("u")))).alias("z"))
    ordered = scored.repartition("_ka", "_kb").sortWithinPartitions("_ka", "_kb", "feature_id").select("_ka", "_kb", "z")
    whole = ordered.mapInArrow(together, "_ka long, _kb long, _z array<double>")
    found = keyed.join(whole, ["_ka", "_kb"], "left")
    x = F.col("_row.x")
    made = F.when(F.size(x) > 0, F.col("_z")).otherwise(x.cast("array<double>"))
    return found.select(*[made.alias("x") if c == "x" else F.col(f"_row.`{c}`") for c in rows.columns])


def from_gaussian(queries: DataFrame, train: DataFrame, z: str = "z", value: str = "v", by: list[str] | None = None) -> DataFrame:
    """Normal-scale values back on the training sample's scale, as column x (replaced if there is one)."""
    e = ecdf(train, value, by)
    ends = e.select(*(by or []), value, F.explode(F.array_distinct(F.array("u_low", "u_high"))).alias("_u"))
    return interpolate(queries.withColumn("_p", ndtr(F.col(z))), ends, "_p", "_u", value, value, by, out="x").drop("_p")


def fit_parametric(df: DataFrame, family: str, value: str = "v") -> dict[str, float]:
    """Parameters of a family from one pass: moments for counts, maximum likelihood for the rest."""
    v = F.col(value).cast("double")
    s = df.where(v.isNotNull()).agg(F.avg(v).alias("m"), F.var_pop(v).alias("s2"), F.max(v).alias("top"), F.min(v).alias("low"), F.avg(F.when(v > 0, F.ln(v))).alias("lm"), F.var_pop(F.when(v > 0, F.ln(v))).alias("ls2")).first()
    if s.m is None:
        raise ValueError("no value to fit a marginal to")
    if family == "poisson":
        return {"mu": max(s.m, 1e-6)}
    if family == "nbinom":
        var = s.s2 if s.s2 > s.m else s.m * 1.01 + 1e-6
        r = max(s.m**2 / (var - s.m), 1e-3)
        return {"r": r, "p": r / (r + s.m)}
    if family == "binom":
        n = round(s.top)
        return {"n": float(n), "p": min(max(s.m / max(n, 1), 1e-6), 1 - 1e-6)}
    if family == "geom":
        return {"p": min(max(1 / max(s.m, 1.0), 1e-6), 1 - 1e-6)}
    if family == "norm":
        return {"loc": s.m, "scale": math.sqrt(s.s2)}
    if family == "lognorm":
        return {"loc": s.lm, "scale": math.sqrt(s.ls2)}
    if family == "expon":
        return {"loc": s.low, "scale": max(s.m - s.low, 1e-12)}
    raise ValueError(f"no marginal family {family!r}")


def log_pmf(k: Column, family: str, p: dict[str, float]) -> Column:
    """Log-probability of a count."""
    if family == "poisson":
        return k * math.log(p["mu"]) - p["mu"] - lgamma(k + 1)
    if family == "nbinom":
        return lgamma(k + p["r"]) - math.lgamma(p["r"]) - lgamma(k + 1) + p["r"] * math.log(p["p"]) + k * math.log1p(-p["p"])
    if family == "geom":
        return math.log(p["p"]) + (k - 1) * math.log1p(-p["p"])
    return math.lgamma(p["n"] + 1) - lgamma(k + 1) - lgamma(p["n"] - k + 1) + k * math.log(p["p"]) + (p["n"] - k) * math.log1p(-p["p"])


def parametric_scores(df: DataFrame, family: str, p: dict[str, float], value: str = "v", jitter: str | None = None, support: int | None = None) -> DataFrame:
    """``df`` with z under fitted parameters; counts need a ``jitter`` column in 0..1.

    A null has no score, nor has what isn't a count where counts are asked for.
    A count's distribution function is summed over a table of the counts up to
    the largest seen, which is broadcast up to ``BROADCAST_COUNTS`` rows and
    joined by a shuffle beyond.
    """
    v = F.col(value).cast("double")
    if family in ("norm", "lognorm"):
        x = v if family == "norm" else F.ln(v)
        return df.withColumn("z", ndtri(_held(ndtr((x - p["loc"]) / p["scale"]))))
    if family == "expon":
        return df.withColumn("z", ndtri(_held(1 - F.exp(-(v - p["loc"]) / p["scale"]))))
    if jitter is None:
        raise ValueError("counts need a jitter column")
    top = support if support is not None else int(df.agg(F.max(v)).first()[0] or 0)
    spark = df.sparkSession
    counts = spark.range(0, top + 1).select(F.col("id").cast("double").alias("_k"))
    counts = counts.withColumn("_pmf", F.when(F.lit(family == "geom") & (F.col("_k") < 1), 0.0).otherwise(F.exp(log_pmf(F.col("_k"), family, p))))
    counts = counts.withColumn("_below", F.coalesce(F.sum("_pmf").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = df.join(F.broadcast(counts) if top <= BROADCAST_COUNTS else counts.hint("merge"), v == F.col("_k"), "left")
    u = F.col("_below") + F.col(jitter) * F.greatest(F.col("_pmf"), F.lit(1e-12))
    return out.withColumn("z", ndtri(_held(u))).drop("_k", "_pmf", "_below")
