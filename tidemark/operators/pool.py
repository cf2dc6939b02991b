"""Pools of candidates, finishes, windows of games, absences, strength of opponents and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.operators import joins, windows


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The latest visible row of each key."""
    return windows.first_of(df, by, order)


def membership(base: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """base with in_pool and excluded_by, the first rule that takes a row out."""
    why = F.coalesce(*[F.when(c, name) for name, c in rules])
    return base.withColumn("excluded_by", why).withColumn("in_pool", F.col("excluded_by").isNull())


def weekly(statuses: DataFrame, by: list[str], season: str, status: str) -> DataFrame:
    """Per season whether statuses are kept weekly: some entity has two of them."""
    per = statuses.groupBy(season, *by).agg((F.min(status) != F.max(status)).alias("varies"))
    return per.groupBy(season).agg(F.coalesce(F.bool_or("varies"), F.lit(False)).alias("weekly"))


def finishes(scores: DataFrame, week: list[str], group: str, score: str, thresholds: dict[str, int]) -> DataFrame:
    """scores with `finish` (competition rank in its week and group), `of`, and a flag for each threshold (a finish at or above it)."""
    placed = windows.with_places(scores, score, [*week, group])
    out = placed.withColumn("finish", F.col("of") - F.col("below") - F.col("n") + 1).drop("n", "below")
    return out.withColumns({name: F.col("finish") <= most for name, most in thresholds.items()})


def position_at(scores: DataFrame, positions: DataFrame, key: str, week: str, position: str, default: Column) -> DataFrame:
    """scores with the position of the same week, else of the latest week before, else `default`."""
    return joins.asof_join(scores, positions, [key], week, week, [position]).withColumn(position, F.coalesce(f"prior_{position}", default)).drop(f"prior_{position}")


def upcoming(keys: DataFrame, games: DataFrame, team: str, week: str, n: int) -> DataFrame:
    """keys with `slots`: the first n games of their team after their week, in order: a ranked equi join, cut before it is gathered."""
    per = games.groupBy(team).agg(F.array_sort(F.collect_list(F.struct(F.col(week).alias("week"), *[c for c in games.columns if c not in (team, week)]))).alias("_games"))
    ahead = F.slice(F.filter("_games", lambda g: g["week"] > F.col(week)), 1, n)
    return keys.join(per, team, "left").withColumn("slots", F.coalesce(ahead, F.slice("_games", 1, 0))).drop("_games")


def hits(slots: DataFrame, key: list[str], n: int, need: int, last: str, now: Column) -> DataFrame:
    """Per key of slots (hit, and `last`, when its outcome is final): counts, and whether it made `need` hits of n; null while that can
    still change: some of its slots aren't final and it has neither enough hits nor too many misses."""
    final = F.col(last) <= now
    got, lost = F.count_if(final & F.col("hit")), F.count_if(final & ~F.col("hit"))
    per = slots.groupBy(*key).agg(F.count("*").alias("n_slots"), got.alias("n_hits"), lost.alias("n_misses"))
    label = F.when(F.col("n_hits") >= need, True).when(F.col("n_slots") - F.col("n_misses") < need, False)
    return per.withColumn("label", label)


def recency(games: DataFrame, team: str, order: list[str]) -> DataFrame:
    """games with k: 1 for a team's latest game, 2 for the one before."""
    return games.withColumn("k", F.row_number().over(windows.backward([team], order)))


def form(games: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Last value, mean of the last n, mean of all, and how far the first is from the last (games with k from recency())."""
    v = F.col(value)
    per = games.groupBy(*by).agg(F.max(F.when(F.col("k") == 1, v)).alias("last"), F.avg(F.when(F.col("k") <= n, v)).alias("recent"), F.avg(v).alias("season"))
    return per.withColumn("delta", F.col("recent") - F.col("season"))


def vacated(values: DataFrame, absent: DataFrame, key: str, team: str, value: str) -> DataFrame:
    """Per team: the share of `value` whose holders are absent, how many they are, and the largest of them."""
    out = values.join(absent.select(F.col(key).alias("_k"), F.lit(True).alias("_out")).distinct(), F.col(key) == F.col("_k"), "left")
    gone = F.col("_out").isNotNull()
    lost = F.sum(F.when(gone, F.col(value)).otherwise(0))
    return out.groupBy(team).agg(ratio(lost, F.sum(value)).alias("share"), F.count_if(gone).alias("n_out"), F.max_by(key, F.when(gone, F.struct(value, key))).alias("largest"))


def strength(scores: DataFrame, opponent: str, group: str, points: str, opponents: DataFrame) -> DataFrame:
    """Points that each opponent allows a group per game against the group's mean, on the complete grid: no games, ratio 1."""
    per = scores.groupBy(opponent, group).agg(F.avg(points).alias("allowed"), F.count("*").alias("n"))
    league = scores.groupBy(group).agg(F.avg(points).alias("league"))
    grid = joins.complete(per, [opponents.select(opponent).distinct(), scores.select(group).distinct()], {"n": 0})
    return grid.join(league, group).withColumn("ratio", F.coalesce(ratio(F.col("allowed"), F.col("league")), F.lit(1.0))).select(opponent, group, "n", "ratio")


def schedule(slots: DataFrame, key: list[str], ratio_column: str, horizon: int) -> DataFrame:
    """Per key over its next fixtures: mean opponent ratio (unknown: 1), games, and whether a bye is among the weeks of the horizon."""
    return slots.groupBy(*key).agg(F.avg(F.coalesce(ratio_column, F.lit(1.0))).alias("mean_ratio"), F.count("*").alias("n_games"), (F.count_distinct("week") < horizon).alias("bye"))


def breakouts(lists: DataFrame, entity: str, season: str, week: str, hit: str, length: int) -> DataFrame:
    """First week of each entity and season from which `hit` holds in `length` consecutive rows."""
    w = Window.partitionBy(entity, season).orderBy(week).rowsBetween(0, length - 1)
    run = (F.sum(F.col(hit).cast("int")).over(w) == length) & (F.count("*").over(w) == length)
    return lists.withColumn("_run", run).where("_run").groupBy(entity, season).agg(F.min(week).alias("breakout"))


def ranks_with_age(pages: DataFrame, entity: str, group: str, day: str, place: str, max_age: int) -> DataFrame:
    """Each entity's newest row of its group that is at most max_age days older than the group's newest page, with that age."""
    newest = pages.groupBy(group).agg(F.max(day).alias("_newest"))
    aged = pages.join(newest, group).withColumn("age", F.date_diff("_newest", day)).where(F.col("age") <= max_age)
    return windows.first_of(aged, [group, entity], [F.col(day).desc(), F.col(place)]).select(group, entity, place, "age")
