"""Point rules of a fantasy league: linear scores with bonuses by distance and tiers, expected points, situations of a play."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import flag


def _points(column: Column, weight: float) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0)) * F.lit(float(weight))


def score(df: DataFrame, rules: Mapping[str, float], name: str = "points", breakdown: bool = False) -> DataFrame:
    """df with the weighted sum of its stat columns, null as zero. A stat that df lacks is an error. breakdown: a column of points for each stat too."""
    if missing := sorted(rules.keys() - set(df.columns)):
        raise ValueError(f"no columns {missing}")
    parts = {c: _points(F.col(c), w) for c, w in rules.items()}
    out = df.withColumn(name, reduce(lambda a, b: a + b, parts.values()))
    return out.withColumns({f"{name}_{c}": p for c, p in parts.items()}) if breakdown else out


def score_sql(rules: Mapping[str, float], alias: str | None = None) -> str:
    """The same sum as SQL text."""
    dot = f"{alias}." if alias else ""
    return " + ".join(f"coalesce(CAST({dot}{c} AS DOUBLE), 0.0) * {float(w)!r}" for c, w in rules.items())


def expected(df: DataFrame, rules: Mapping[str, float], name: str = "xfp") -> DataFrame:
    """Points of expected stats: the columns <stat>_exp under the same weights."""
    return score(df, {f"{c}_exp": w for c, w in rules.items()}, name)


def expected_sql(rules: Mapping[str, float], alias: str | None = None) -> str:
    return score_sql({f"{c}_exp": w for c, w in rules.items()}, alias)


def tier_points(value: Column, tiers: Sequence[tuple[float | None, float]]) -> Column:
    """Points of the first tier (at most, points) that holds the value; the last is open. Null counts as zero points."""
    out = F.lit(float(tiers[-1][1]))
    for most, points in reversed(tiers[:-1]):
        out = F.when(value <= most, F.lit(float(points))).otherwise(out)
    return F.when(value.isNotNull(), out).otherwise(F.lit(0.0))


def score_kicking(df: DataFrame, made: Mapping[str, float], missed: Mapping[str, float], extra: float, extra_missed: float, name: str = "points") -> DataFrame:
    """Kicks by distance bucket (columns made_<bucket>, missed_<bucket>) and extra points (made_xp, missed_xp)."""
    rules = {f"made_{b}": w for b, w in made.items()} | {f"missed_{b}": w for b, w in missed.items()} | {"made_xp": extra, "missed_xp": extra_missed}
    return score(df, rules, name)


def score_defense(df: DataFrame, rules: Mapping[str, float], points_tiers: Sequence[tuple[float | None, float]], yards_tiers: Sequence[tuple[float | None, float]], name: str = "points") -> DataFrame:
    """Linear stats of a defense plus tiers of points_allowed and yards_allowed."""
    tiers = tier_points(F.col("points_allowed"), points_tiers) + tier_points(F.col("yards_allowed"), yards_tiers)
    return score(df, rules, name).withColumn(name, F.col(name) + tiers)


def garbage_time(wp: Column, seconds_left: Column, margin: Column, low: float = 0.05, high: float = 0.95, late: int = 300, close: int = 8) -> Column:
    """The game is all but decided, and not late and close. Unknown is false."""
    return flag(((wp < low) | (wp > high)) & ~flag((seconds_left <= late) & (F.abs(margin) <= close)))


def neutral(wp: Column, half_seconds_left: Column, low: float = 0.2, high: float = 0.8, clock: int = 120) -> Column:
    """The game is open and the half isn't about to end. Unknown is false."""
    return flag(wp.between(low, high) & (half_seconds_left > clock))


def flagged(plays: DataFrame) -> DataFrame:
    """plays (wp, seconds_left, half_seconds_left, margin) with garbage_time and neutral."""
    return plays.withColumns({"garbage_time": garbage_time(F.col("wp"), F.col("seconds_left"), F.col("margin")), "neutral": neutral(F.col("wp"), F.col("half_seconds_left"))})
