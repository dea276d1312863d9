"""Sources and sinks: input tables, design rows, saved models, generated data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; columns and filters are pushed to its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: str):
    """Seconds since 1970 of a zoneless timestamp, as a double (session zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def wide(df: DataFrame, row_id: str, y: str, xs: list[str], offset: str | None = None) -> DataFrame:
    """(row_id, y, x, off): numeric columns as one array; rows with a null anywhere are left out."""
    off = F.col(offset).cast("double") if offset else F.lit(0.0)
    return df.select(F.col(row_id).alias("row_id"), F.col(y).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in xs]).alias("x"), off.alias("off")).dropna().where(~F.exists("x", F.isnull))


def long(rows: DataFrame) -> DataFrame:
    """(row_id, feature_id, v) from wide rows."""
    return rows.select("row_id", F.posexplode("x").alias("feature_id", "v"))


def from_arrays(spark: SparkSession, x, y=None, offset=None) -> DataFrame:
    """Wide rows from in-memory arrays, in their order."""
    n = len(x)
    data = [(i, float(y[i]) if y is not None else None, [float(v) for v in x[i]], float(offset[i]) if offset is not None else 0.0) for i in range(n)]
    return spark.createDataFrame(data, "row_id long, y double, x array<double>, off double")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(spark: SparkSession, path: str, kind: str, params: dict, arrays: dict[str, list]) -> None:
    """Parameters as JSON and arrays as Parquet rows under ``path``; nothing executable is stored."""
    rows = [("", json.dumps({"class": kind, "params": params}), None)] + [(k, None, [float(v) for v in a]) for k, a in arrays.items()]
    spark.createDataFrame(rows, "name string, meta string, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, kind: str) -> tuple[dict, dict[str, list]]:
    """What ``save_model`` wrote; another class raises TypeError."""
    rows = spark.read.parquet(path).collect()
    meta = json.loads(next(r.meta for r in rows if r.name == ""))
    if meta["class"] != kind:
        raise TypeError(f"saved model is a {meta['class']}, not a {kind}")
    return meta["params"], {r.name: r.v for r in rows if r.name}


def gaussian_data(spark: SparkSession, n: int, p: int, beta: dict[int, float], intercept: float = 0.0, noise: float = 1.0, seed: int = 0, family: str = "gaussian") -> DataFrame:
    """Generated wide rows: independent normal features, a sparse linear predictor, and a response of the family."""
    xs = [F.randn(seed * 1000 + j) for j in range(p)]
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.array(*xs).alias("x"), F.randn(seed * 1000 + p).alias("e"), F.rand(seed * 1000 + p + 1).alias("u"))
    eta = F.lit(intercept) + sum((F.col("x")[j] * b for j, b in beta.items()), F.lit(0.0))
    y = {"gaussian": eta + noise * F.col("e"), "bernoulli": (F.col("u") < 1 / (1 + F.exp(-eta))).cast("double")}[family]
    return rows.select("row_id", y.alias("y"), "x", F.lit(0.0).alias("off"))
