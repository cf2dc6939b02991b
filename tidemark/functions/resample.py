"""Bootstrap over whole blocks, intervals, reliability, isotonic bins. Draws come from a hash of seed, draw and place, so every run and every engine draws alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.operators import windows


def drawn(seed: int, draw: Column, place: Column, n: Column) -> Column:
    """A number from 0 to n - 1: the first 32 bits of md5('seed-draw-place'), modulo n."""
    text = F.concat_ws("-", F.lit(str(seed)), draw.cast("string"), place.cast("string"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long") % n


def index_table(blocks: DataFrame, block: str, draws: int, seed: int) -> DataFrame:
    """(draw, block, times): in each draw as many blocks, with replacement, as there are. blocks: one row a block; blocks are few, so
    their numbering and the table (draws x blocks) are small by definition."""
    every = Window.partitionBy()
    numbered = blocks.select(block).withColumns({"_i": F.row_number().over(Window.orderBy(block)).cast("long") - 1, "_n": F.count("*").over(every)})
    places = numbered.select(F.col("_i").alias("_place"), "_n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = places.select("draw", drawn(seed, F.col("draw"), F.col("_place"), F.col("_n")).alias("_i")).groupBy("draw", "_i").agg(F.count("*").alias("times"))
    return picks.join(numbered.select("_i", block), "_i").select("draw", block, "times")


def interval(draws: DataFrame, value: str, level: float = 0.9) -> DataFrame:
    """One row: low and high end of the middle `level` of draws, and how many of them are above zero."""
    tail = (1 - level) / 2
    return draws.agg(F.round(F.percentile(value, tail), 9).alias("low"), F.round(F.percentile(value, 1 - tail), 9).alias("high"), F.round(F.avg((F.col(value) > 0).cast("double")), 9).alias("above_zero"))


def block_means(df: DataFrame, block: str, value: str, draws: int, seed: int) -> DataFrame:
    """(draw, mean): mean of value over the rows of the blocks drawn. Only per-block sums meet the draws."""
    sums = df.groupBy(block).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    picks = index_table(sums, block, draws, seed)
    return picks.join(sums, block).groupBy("draw").agg(ratio(F.sum(F.col("times") * F.col("_s")), F.sum(F.col("times") * F.col("_c"))).alias("mean"))


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of a and b by key with `difference` a - b. Both must have the same groups, each once."""
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    odd = x.select(*keys).exceptAll(y.select(*keys)).unionAll(y.select(*keys).exceptAll(x.select(*keys)))
    if not odd.limit(1).isEmpty():
        raise ValueError(f"the two sides have different groups, e.g. {odd.first()}")
    return x.join(y, list(keys)).withColumn("difference", F.col("_a") - F.col("_b")).drop("_a", "_b")


def resampled_auc(df: DataFrame, score: str, label: str, block: str, draws: int, seed: int) -> DataFrame:
    """(draw, roc_auc) with whole blocks drawn: rows meet the draws as counts by block and score; ties count half."""
    per = df.groupBy(block, score).agg(F.sum(label).alias("_pos"), F.count("*").alias("_all"))
    picks = index_table(per.select(block).distinct(), block, draws, seed)
    each = per.join(picks, block).groupBy("draw", score).agg(F.sum(F.col("times") * F.col("_pos")).alias("_p"), F.sum(F.col("times") * (F.col("_all") - F.col("_pos"))).alias("_q"))
    below = Window.partitionBy("draw").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("under", F.coalesce(F.sum("_q").over(below), F.lit(0)))
    wins = F.sum(F.col("_p") * (2 * F.col("under") + F.col("_q")))
    return each.groupBy("draw").agg(ratio(wins, 2 * F.sum("_p") * F.sum("_q")).alias("roc_auc"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the Wilson interval of hits / n, within [0, 1]; null without rows."""
    p, m = ratio(hits, n), n.cast("double")
    mid, half, whole = p + F.lit(z * z) / (2 * m), F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m)), 1 + F.lit(z * z) / m
    return F.greatest((mid - half) / whole, F.lit(0.0)), F.least((mid + half) / whole, F.lit(1.0))


def isotonic(df: DataFrame, score: str, label: str, tie: str, bins: int) -> DataFrame:
    """(bin, n, rate, fitted): equal-count bins in order of score, and the non-decreasing rates closest to theirs (pooled adjacent
    violators): the fit of a bin is the largest, over starts at or before it, of the smallest mean of stretches that reach it. Pairs of bins, never of rows."""
    dealt = windows.ordinal(df, score, tie, []).withColumn("bin", F.floor((F.col("rn") - 1) * bins / F.col("of")).cast("long"))
    per = dealt.groupBy("bin").agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"cn": F.sum("n").over(run), "cp": F.sum("pos").over(run)})
    start = per.select(F.col("bin").alias("a"), (F.col("cn") - F.col("n")).alias("an"), (F.col("cp") - F.col("pos")).alias("ap"))
    end = per.select(F.col("bin").alias("b"), F.col("cn").alias("bn"), F.col("cp").alias("bp"))
    at = per.select("bin").join(start, F.col("a") <= F.col("bin")).join(end, F.col("b") >= F.col("bin"))
    mean = (F.col("bp") - F.col("ap")) / (F.col("bn") - F.col("an"))
    fitted = at.groupBy("bin", "a").agg(F.min(mean).alias("m")).groupBy("bin").agg(F.max("m").alias("fitted"))
    return per.join(fitted, "bin").select("bin", "n", ratio(F.col("pos"), F.col("n")).alias("rate"), "fitted")


def pearson(a: str, b: str) -> Column:
    """Correlation; null below three pairs or without spread."""
    ok = (F.count(F.col(a) + F.col(b)) >= 3) & (F.stddev_samp(a) > 0) & (F.stddev_samp(b) > 0)
    return F.when(ok, F.corr(a, b))


def signal_noise(a: str, b: str) -> tuple[Column, Column]:
    """Variance of what two halves share, and of what each has besides: their covariance, and half the variance of their difference."""
    return F.covar_samp(a, b), F.var_samp(F.col(a) - F.col(b)) / 2


def reliability(signal: Column, noise: Column, g: Column | float) -> Column:
    """Share of the signal in a mean of g halves; 0 if there is no signal, null if nothing varies."""
    g = F.lit(float(g)) if isinstance(g, (int, float)) else g
    s = F.greatest(signal, F.lit(0.0))
    return F.when(s + noise / g > 0, s / (s + noise / g))
