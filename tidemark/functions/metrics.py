"""Ranking, probability and calibration metrics as aggregations; ties are settled by an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, ratio
from tidemark.operators import windows


def ranked(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """df with `place`: 1 for the highest score in each group, ties by id."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("place", F.row_number().over(w).cast("long"))


def precision_at(df: DataFrame, by: list[str], score: str, label: str, tie: str, k: int) -> DataFrame:
    """Hits among the first k of each group, and their share of those rows."""
    top = ranked(df, by, score, tie).where(F.col("place") <= k)
    return top.groupBy(*by).agg(F.sum(label).cast("long").alias("hits"), F.count("*").alias("n")).withColumn("precision", ratio(F.col("hits"), F.col("n")))


def at_k(ranked: DataFrame, by: list[str], label: str, k: int, place: str = "place") -> DataFrame:
    """Per group of a ranked list: rows, positives, hits among the first k, precision over k, and whether it is shorter than k."""
    hits = F.coalesce(F.sum(F.when(F.col(place) <= k, F.col(label))), F.lit(0)).cast("long")
    per = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("pos"), hits.alias("hits"))
    return per.withColumns({"precision": F.col("hits") / F.lit(float(k)), "short": F.col("n") < k})


def pooled(per_group: DataFrame) -> DataFrame:
    """Mean precision over groups, each counting once, and what it rests on."""
    return per_group.agg(F.round(F.avg("precision"), 9).alias("precision"), F.count("*").alias("n_groups"), F.count_if("short").alias("n_short"), F.sum("n").cast("long").alias("n_rows"))


def bucket_rates(ranked: DataFrame, label: str, bands: list[tuple[int, int]], place: str = "place") -> DataFrame:
    """Hit rate by band of places, both ends included."""
    band = F.coalesce(*[F.when(F.col(place).between(a, b), f"{a}-{b}") for a, b in bands])
    per = ranked.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("hits"))
    return per.withColumn("rate", ratio(F.col("hits"), F.col("n")))


def brier(p: Column, label: Column) -> Column:
    return F.avg((p - label) * (p - label))


def log_loss(p: Column, label: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return -F.avg(label * F.log(q) + (1 - label) * F.log(1 - q))


def counted_by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score its positives and rows, with running sums from the highest: what tie-aware areas need. Shuffles scores, not rows; the
    running sums are over per-range subtotals, so no task sees more than its range and one row for each other range."""
    per = df.groupBy(score).agg(F.sum(label).cast("long").alias("pos"), F.count("*").alias("n"))
    bins = per.withColumn("bin", F.floor(F.col(score) * 256))
    subtotal = bins.groupBy("bin").agg(F.sum("pos").alias("bin_pos"), F.sum("n").alias("bin_n"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    subtotal = subtotal.select(
        "bin",
        F.coalesce(F.sum("bin_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("bin_n").over(above), F.lit(0)).alias("n_above"),
        F.sum("bin_pos").over(every).alias("all_pos"),
        F.sum("bin_n").over(every).alias("all_n"),
    )
    within = Window.partitionBy("bin").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return bins.join(subtotal, "bin").withColumns({"tp": F.col("pos_above") + F.sum("pos").over(within), "seen": F.col("n_above") + F.sum("n").over(within)})


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Chance that a positive outscores a negative, ties half. Null without both kinds."""
    c = counted_by_score(df, score, label)
    neg_below = (F.col("all_n") - F.col("all_pos")) - (F.col("seen") - F.col("tp"))
    wins = F.sum(F.col("pos") * (2 * neg_below + F.col("n") - F.col("pos")))
    return c.agg(ratio(wins, 2 * F.max("all_pos") * (F.max("all_n") - F.max("all_pos"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over distinct scores of precision there times recall gained there."""
    c = counted_by_score(df, score, label)
    return c.agg(F.round(F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("seen")), 9).alias("average_precision"))


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """Fixed-width bins of [0, 1], empty ones too."""
    spark = df.sparkSession
    where = F.least(F.floor(clip(F.col(score), 0.0, 1.0) * bins), F.lit(bins - 1)).cast("long")
    got = df.groupBy(where.alias("bin")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"))


def equal_count_bins(df: DataFrame, score: str, tie: str, bins: int, by: list[str]) -> DataFrame:
    """df with `bin`: rows of a group in order of score, dealt into bins as equal as can be."""
    return windows.ordinal(df, score, tie, by).withColumn("bin", F.floor((F.col("rn") - 1) * bins / F.col("of")).cast("long")).drop("rn", "of")
