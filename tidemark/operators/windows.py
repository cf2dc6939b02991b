"""Window operators with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import scratch


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first under a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def next_valid(value: str, by: list[str], order: list[str]) -> Column:
    """The first non-null value after a row: in descending order the last one before it, so the frame only grows."""
    return F.last(value, ignorenulls=True).over(backward(by, order).rowsBetween(Window.unboundedPreceding, -1))


def backward(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in order])


def trailing(by: list[str], order: list[str], n: int) -> Window:
    """The n rows before a row."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with `island`: number of the run of equal values that a row is in, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_s")


def _smaller(sorted_: Column, v: Column, most: int) -> Column:
    """How many of a sorted array's `most` elements or fewer are smaller than v, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_, at + step - 1) < v, at + step).otherwise(at))


def placed(df: DataFrame, value: str, by: list[str], cuts: int = 255) -> DataFrame:
    """Per group and distinct value (nulls left out): by, value, n rows of it, `below` rows of smaller values, `of` rows in the group.

    Exact for groups of any size, in three steps that all spread: counts per value, running sums within ranges of values, running sums
    over ranges. The ranges are approximate quantiles; they only deal the work out. Those differ from one computation to the next with the
    order in which tasks end, so the values are written once with their ranges, and both running sums read the same ones.
    """
    group = F.xxhash64(F.lit(0), *by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("_g", group)
    quantiles = F.percentile_approx(value, [k / (cuts + 1) for k in range(1, cuts + 1)], 1000)
    groups = counts.groupBy("_g").agg(quantiles.alias("_cuts"), F.sum("n").alias("of"))
    dealt = counts.join(groups, "_g").withColumn("_range", _smaller(F.col("_cuts"), F.col(value), cuts)).drop("_cuts")
    path = scratch(df.sparkSession)
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    ranges = dealt.groupBy("_g", "_range").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_g", "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(ranges, ["_g", "_range"]).withColumn("below", F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return out.select(*by, value, "n", "below", "of")


def with_places(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with n, below and of from placed(); rows without a value have none. by may be null."""
    places = placed(df, value, by)
    same = F.col(value) == F.col("_v")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return df.join(places.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(value).alias("_v"), "n", "below", "of"), same, "left").drop("_v", *[f"_{b}" for b in by])


def ordinal(df: DataFrame, value: str, tie: str, by: list[str], descending: bool = False) -> DataFrame:
    """df with `rn` (place from 1 by value, ties by `tie` ascending) and `of`; only rows alike in value meet in one window."""
    alike = F.row_number().over(Window.partitionBy(*by, value).orderBy(tie))
    before = F.col("of") - F.col("below") - F.col("n") if descending else F.col("below")
    return with_places(df, value, by).withColumn("rn", before + alike).drop("below", "n")


def quantiles(df: DataFrame, value: str, by: list[str], disc: dict[str, float], cont: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, name: fraction; disc: the first value at or above it, cont: between the two next to it."""
    p = placed(df, value, by)
    upto, v = F.col("below") + F.col("n"), F.col(value)
    out = [F.min(F.when(upto >= F.lit(q) * F.col("of"), v)).alias(name) for name, q in disc.items()]
    for name, q in cont.items():
        at = F.lit(q) * (F.col("of") - 1)
        low, high = F.min(F.when(upto > F.floor(at), v)), F.min(F.when(upto > F.ceil(at), v))
        part = F.max(at - F.floor(at))
        out.append((low * (1 - part) + high * part).alias(name))
    return p.groupBy(*by).agg(*out)


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(half)))
