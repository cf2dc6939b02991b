"""Decisions of a play: filters with account, next valid snaps, cells with fallback, expectations, options, clocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows


def first_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; unknown doesn't hold; null if none does."""
    return F.coalesce(*[F.when(c, name) for name, c in rules])


def filtered(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all steps, and the account (step, name, dropped, remaining) of what each dropped in its turn, in one pass over df."""
    failed = first_rule([(name, ~F.coalesce(c, F.lit(False))) for name, c in steps])
    kept = reduce(lambda d, s: d.where(s[1]), steps, df)
    counted = df.agg(F.count("*").alias("all"), *[F.count_if(failed == name).alias(f"d{i}") for i, (name, _) in enumerate(steps)])
    rows, left = [], F.col("all")
    for i, (name, _) in enumerate(steps):
        left = left - F.col(f"d{i}")
        rows.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"d{i}").alias("dropped"), left.alias("remaining")))
    return kept, counted.select(F.inline(F.array(*rows)))


def next_snap(df: DataFrame, by: list[str], order: list[str], valid: Column, columns: Mapping[str, str]) -> DataFrame:
    """df with columns of the next row that is a valid snap: {column: new name}."""
    w = windows.backward(by, order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(valid, F.struct(*[F.col(c).alias(n) for c, n in columns.items()]))
    out = df.withColumn("_next", F.last(held, ignorenulls=True).over(w))
    return out.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in columns.values()])


def expanding_median(df: DataFrame, by: list[str], season: str, week: str, value: str, least: int) -> DataFrame:
    """Per group, season and week: the mean and median of `value` in strictly earlier weeks of the season if there are `least` of them, else of the whole season before; null without."""
    w = Window.partitionBy(*by, season).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*by, season, week).agg(F.collect_list(value).alias("_v"))
    held = per.withColumn("_own", F.flatten(F.collect_list("_v").over(w)))
    whole = df.groupBy(*by, (F.col(season) + 1).alias(season)).agg(F.avg(value).alias("_mean"), F.median(value).alias("_median"))
    held = held.join(whole, [*by, season], "left")
    own = F.array_sort("_own")
    n = F.size(own)
    middle = (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2
    mean = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / n
    enough = n >= least
    return held.select(*by, season, week, F.when(enough, mean).otherwise(F.col("_mean")).alias("mean"), F.when(enough, middle).otherwise(F.col("_median")).alias("median"))


def cells(train: DataFrame, keys: Sequence[str], outcome: str, least: int) -> DataFrame:
    """(level, keys, outcome, p): distributions of `outcome` by all keys, by ever fewer of them from the left, and of all rows; a level's
    cells with fewer than `least` rows are left out, but for the last. One pass: levels are grouping sets."""
    counts = train.groupBy(*keys, outcome).agg(F.count("*").alias("n"))
    out = None
    for k in range(len(keys), -1, -1):
        own = list(keys[:k])
        part = counts.groupBy(*own, outcome).agg(F.sum("n").alias("n"))
        whole = counts.groupBy(*own).agg(F.sum("n").alias("_all")) if own else counts.agg(F.sum("n").alias("_all"))
        part = (part.join(whole, own) if own else part.crossJoin(whole)).where((F.col("_all") >= least) | F.lit(k == 0))
        part = part.select(F.lit(k).alias("level"), *[F.col(c) if c in own else F.lit(None).cast(train.schema[c].dataType).alias(c) for c in keys], outcome, (F.col("n") / F.col("_all")).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def with_distribution(rows: DataFrame, table: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """rows with `outcomes` (array of outcome, p) of their deepest cell, and its `level`."""
    packed = table.groupBy("level", *keys).agg(F.array_sort(F.collect_list(F.struct(F.col(outcome).alias("outcome"), "p"))).alias("d"))
    out, found = rows, []
    for k in range(len(keys), -1, -1):
        own = packed.where(F.col("level") == k).select(*[F.col(c).alias(f"_{c}") for c in keys[:k]], F.col("d").alias(f"_d{k}"))
        same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(F.col(f"_{c}")) for c in keys[:k]], F.lit(True))
        out = out.join(own, same, "left").drop(*[f"_{c}" for c in keys[:k]])
        found.append(k)
    deepest = F.coalesce(*[F.when(F.col(f"_d{k}").isNotNull(), F.lit(k)) for k in found])
    return out.select(*rows.columns, F.coalesce(*[F.col(f"_d{k}") for k in found]).alias("outcomes"), deepest.alias("level"))


def expectation(outcomes: Column, value) -> Column:
    """Sum of p * value(outcome) over a distribution, in decimals, so in any order the same."""
    total = F.aggregate(outcomes, F.lit(0).cast("decimal(38,12)"), lambda s, o: (s + (o["p"] * value(o["outcome"])).cast("decimal(30,12)")).cast("decimal(38,12)"))
    return total.cast("double")


def kernel_table(rows: DataFrame, at: str, outcome: str, bandwidth: float, span: int) -> DataFrame:
    """(at, outcome, p): outcome distributions at every place, smoothed over neighbouring places by a Gaussian kernel cut at `span`."""
    counts = rows.groupBy(at, outcome).agg(F.count("*").alias("n"))
    spread = counts.select(F.explode(F.sequence(F.col(at) - span, F.col(at) + span)).alias("_at"), outcome, "n", F.col(at).alias("_from"))
    k = F.exp(-F.pow((F.col("_at") - F.col("_from")) / F.lit(float(bandwidth)), 2) / 2)
    there = spread.join(counts.select(F.col(at).alias("_at")).distinct(), "_at", "left_semi")
    mass = there.groupBy(F.col("_at").alias(at), outcome).agg(F.sum(F.col("n") * k).alias("m"))
    return mass.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy(at))).drop("m")


def decided(options: Mapping[str, Column], toss_up: float = 0.01, clear: float = 0.03) -> dict[str, Column]:
    """Columns of a decision: best option (ties to the first named; null options don't count), its value, the second best, the gap, and a grade of it."""
    named = F.filter(F.array(*[F.struct(v.cast("double").alias("v"), (-F.lit(i)).alias("o"), F.lit(n).alias("name")) for i, (n, v) in enumerate(options.items())]), lambda x: x["v"].isNotNull())
    order = F.reverse(F.array_sort(named))
    best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    gap = best["v"] - second["v"]
    grade = F.when(second["v"].isNull(), "only option").when(gap < toss_up, "toss-up").when(gap >= clear, "clear").otherwise("lean")
    return {"best": best["name"], "best_value": best["v"], "second": second["name"], "gap": gap, "grade": F.when(best["name"].isNotNull(), grade)}


def platt(df: DataFrame, p: str, label: str, steps: int = 8) -> tuple[float, float]:
    """(a, b) of sigmoid(a + b * logit(p)) by Newton's method: each step is one aggregation of five sums, whatever the number of rows."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    x = df.select(F.log(q / (1 - q)).alias("x"), F.col(label).cast("double").alias("y"))
    a, b = 0.0, 1.0
    for _ in range(steps):
        fit = F.lit(1.0) / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = fit * (1 - fit)
        g0, g1, h00, h01, h11 = x.agg(F.sum(F.col("y") - fit), F.sum((F.col("y") - fit) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        det = h00 * h11 - h01 * h01
        if not det:
            break
        a, b = a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det
    return a, b


def bilinear(table: DataFrame, x: str, y: str, value: str, rows: DataFrame, at_x: str, at_y: str, log_y: bool = False) -> DataFrame:
    """rows with `value` read from a grid table by bilinear interpolation, ends held; log_y: y by log(1 + y). The grid is one array, a row of it a x, so its size is its own."""
    packed = table.groupBy(x).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v")))).alias("ys"))
    grid = packed.agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), "ys"))).alias("_grid"))
    scale = (lambda c: F.log1p(c)) if log_y else (lambda c: c)

    def around(points: Column, key: str, at: Column) -> tuple[Column, Column]:
        below, above = F.filter(points, lambda p: p[key] <= at), F.filter(points, lambda p: p[key] >= at)
        first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
        return F.coalesce(F.try_element_at(below, F.lit(-1)), first), F.coalesce(F.get(above, F.lit(0)), last)

    def part(low: Column, high: Column, at: Column) -> Column:
        return F.when(high > low, (F.least(F.greatest(at, low), high) - low) / (high - low)).otherwise(0.0)

    def along(row: Column) -> Column:
        low, high = around(row["ys"], "y", F.col("_y"))
        t = part(scale(low["y"]), scale(high["y"]), scale(F.col("_y")))
        return low["v"] + (high["v"] - low["v"]) * t

    out = rows.withColumns({"_x": F.col(at_x).cast("double"), "_y": F.col(at_y).cast("double")}).crossJoin(grid)  # one row
    low, high = around(F.col("_grid"), "x", F.col("_x"))
    out = out.withColumns({"_low": low, "_high": high})
    t = part(F.col("_low")["x"], F.col("_high")["x"], F.col("_x"))
    a, b = along(F.col("_low")), along(F.col("_high"))
    return out.withColumn(value, a + (b - a) * t).select(*rows.columns, value)
