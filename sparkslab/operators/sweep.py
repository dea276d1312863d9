"""Sweeps along a sorted column in range buckets: running sums and neighbours without one task for a whole group.

A group's rows are dealt into buckets by approximate quantiles of the column, so
equal values share a bucket.  Windows run inside buckets; between them go one
row a bucket.  Groups may have null keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group, and the accuracy of their quantiles.
BUCKETS, ACCURACY = 64, 1_000


def group_key(by: list[str]) -> Column:
    """One column for a group's keys; a null key is a key."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def bounds(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(_g, _bounds): the inner ends of each group's buckets."""
    return df.groupBy(group_key(by).alias("_g")).agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], ACCURACY).alias("_bounds"))


def bucketed(df: DataFrame, value: str, by: list[str], ends: DataFrame) -> DataFrame:
    """``df`` with _g and _bucket, dealt by both; a group without ends is one bucket.

    Without dealing anew, the join's partitioning by group would also serve
    what is asked for by group and bucket, and a group would be one task.
    """
    keyed = df.withColumn("_g", group_key(by)).join(ends, "_g", "left")
    keyed = keyed.withColumn("_bucket", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(value))), F.lit(0))).drop("_bounds")
    return keyed.repartition("_g", "_bucket")


def running(df: DataFrame, value: str, sums: dict[str, Column], by: list[str], following: str | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums``: its total over the group's rows whose value is not larger.

    ``following`` names one more column, the value of the group's next row
    (null for the last); ``whole`` names columns with the group's total of one of
    ``sums``, which come with the buckets' sums and not by a join of the group.
    """
    whole = whole or {}
    some = df
    for name, of in sums.items():
        some = some.withColumn(f"_v{name}", of)
    some = bucketed(some, value, by, bounds(df, value, by))
    totals = some.groupBy("_g", "_bucket").agg(*[F.sum(f"_v{n}").alias(f"_t{n}") for n in sums], F.min(value).alias("_least"))
    order = Window.partitionBy("_g").orderBy("_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_g", "_bucket", *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_c{n}") for n in sums], *[F.sum(f"_t{n}").over(Window.partitionBy("_g")).alias(f"_a{c}") for c, n in whole.items()], F.lead("_least").over(order).alias("_next"))
    inside = Window.partitionBy("_g", "_bucket").orderBy(value)
    out = some.join(carried, ["_g", "_bucket"])
    more = [F.coalesce(F.lead(value).over(inside), F.col("_next")).alias(following)] if following else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_c{n}") + F.coalesce(F.sum(f"_v{n}").over(inside), F.lit(0))).alias(n) for n in sums], *[F.col(f"_a{c}").alias(c) for c in whole], *more)


def gaps(df: DataFrame, value: str) -> DataFrame:
    """(gap): from each value to the next in order, 0 between equal ones; nulls have none."""
    rows = running(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), "v", {}, [], following="after")
    return rows.select((F.col("after") - F.col("v")).alias("gap")).where("gap is not null")


#: What ``neighbours`` calls the two knots.
BEFORE, AFTER = "_knot_before", "_knot_after"


def neighbours(queries: DataFrame, at: str, knots: DataFrame, by: list[str]) -> DataFrame:
    """``queries`` with BEFORE and AFTER: the group's last knot at or before ``at``, and the first at or after it.

    ``knots`` has the ``by`` columns, x and k (a struct that begins with x).
    """
    ends = bounds(knots, "x", by)
    kind = knots.schema["k"].dataType
    q = queries.select(*by, F.col(at).cast("double").alias("_at"), F.struct(*queries.columns).alias("_row"), F.lit(None).cast(kind).alias("_k"))
    k = knots.select(*by, F.col("x").cast("double").alias("_at"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), F.col("k").alias("_k"))
    both = bucketed(q.unionByName(k), "_at", by, ends).select("_g", "_bucket", "_at", "_row", "_k")
    marks = both.groupBy("_g", "_bucket").agg(F.max_by("_k", "_k.x").alias("_hi"), F.min_by("_k", "_k.x").alias("_lo"))
    past = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy("_g").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_g", "_bucket", F.last("_hi", ignorenulls=True).over(past).alias("_before"), F.last("_lo", ignorenulls=True).over(future).alias("_after"))
    # a knot stands before the queries at its very place, in both directions
    left = Window.partitionBy("_g", "_bucket").orderBy("_at", F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("_g", "_bucket").orderBy(F.desc("_at"), F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_a", F.last("_k", ignorenulls=True).over(left)).withColumn("_b", F.last("_k", ignorenulls=True).over(right)).where("_row is not null")
    out = near.join(carried, ["_g", "_bucket"])
    return out.select("_row.*", F.coalesce("_a", "_before").alias(BEFORE), F.coalesce("_b", "_after").alias(AFTER))
