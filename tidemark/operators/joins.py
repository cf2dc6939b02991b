"""As-of, interval and completion joins without cross joins of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with `values` of the latest right row of its key at or before it (before, if strict); null where there is none.

    Both sides meet in one sorted pass: a union ordered by key and time, in which the last right row is carried forward.
    One shuffle, no join rows. Of right rows alike in key and time the last by value is taken.
    """
    cols = left.columns
    kept = F.struct(*[F.col(v).alias(v) for v in values])
    one = left.select(*by, F.col(left_at).alias("_at"), F.lit(1 if not strict else 0).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(kept.alias("k")).schema["k"].dataType).alias("_value"))
    two = right.select(*by, F.col(right_at).alias("_at"), F.lit(0 if not strict else 1).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), kept.alias("_value"))
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_row is not null")
    return both.select("_row.*", *[F.col(f"_value.{v}").alias(f"prior_{v}") for v in values])


def interval_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, width_s: int, how: str = "inner") -> DataFrame:
    """Points with the spans (start, end] that hold them, through buckets of width_s seconds: an equi join, then the exact bounds."""
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width_s)
    left = points.withColumn("_bucket", bucket(at))
    right = spans.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    inside = (left["_bucket"] == right["_bucket"]) & (F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))
    return left.join(right, inside, how).drop(left["_bucket"]).drop(right["_bucket"])


def complete(df: DataFrame, axes: list[DataFrame], fill: dict[str, object]) -> DataFrame:
    """df with a row for every combination of the axes (small dimension lists), filled where it has none."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)  # no hint: the planner broadcasts what its size allows
    return grid.join(df, grid.columns, "left").fillna(fill)


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal."""
    r = right.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    cond: Column = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(r[f"_r_{c}"])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def melt(df: DataFrame, roles: dict[str, str], keep: list[str], name: str = "role", value: str = "id") -> DataFrame:
    """One row for each role column: (keep, role, id). A single pass over df."""
    pairs = F.array(*[F.struct(F.lit(r).alias(name), F.col(c).alias(value)) for r, c in roles.items()])
    return df.select(*keep, F.inline(pairs))
