"""Column expressions: scores, flags, rates. All stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, below: Column) -> Column:
    """top / below as double; null where below is zero or null."""
    return F.when(below != 0, top.cast("double") / below.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def linear_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum of columns, null counting as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in weights.items()])


def tier_score(x: Column, tiers: Sequence[tuple[float, float]], below: float) -> Column:
    """Points of the highest tier (at least, points) that x reaches; `below` under all; null for null."""
    out = F.lit(float(below))
    for least, points in sorted(tiers):
        out = F.when(x >= least, F.lit(float(points))).otherwise(out)
    return F.when(x.isNotNull(), out)


def flag(condition: Column) -> Column:
    """A condition as true or false; unknown is false."""
    return F.coalesce(condition, F.lit(False))


def horizontal_mean(*columns: Column) -> Column:
    """Mean of the columns that aren't null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return ratio(total, reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]))


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of hits / n."""
    p, m = ratio(hits, n), n.cast("double")
    return (p + F.lit(z * z) / (2 * m) - F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m))) / (1 + F.lit(z * z) / m)


def shrunk(top: Column, n: Column, prior: Column, strength: float) -> Column:
    """Rate drawn to prior as if `strength` more had been seen at it."""
    return (top.cast("double") + F.lit(float(strength)) * prior) / (n.cast("double") + F.lit(float(strength)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def exact_sum(c: str | Column, digits: int = 2) -> Column:
    """Sum over decimals, then double: the same in any order."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{digits})")).cast("double")
