"""The calendar of seasons and weeks, and when things become public in it. All moments are UTC without zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: A week's list is made on the first Tuesday after its first game day, at this hour.
WEEKLY_HOUR = 14
#: Statistics of a game day arrive in a run at this hour.
NIGHTLY_HOUR = 10
#: Wall-clock kickoff by day of week (1 Sunday) where none is given.
DEFAULT_KICKOFF = {1: "13:00", 2: "20:15", 5: "20:20", 7: "16:30"}


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def weekly_as_of(day: Column, hour: int = WEEKLY_HOUR) -> Column:
    """The first Tuesday strictly after a day, at `hour`."""
    return _ntz(F.next_day(day, "TUE")) + F.expr(f"interval {hour} hour")


def next_nightly(moment: Column, hour: int = NIGHTLY_HOUR) -> Column:
    """The first nightly run strictly after a moment."""
    back = F.expr(f"interval {hour} hour")
    return _ntz(F.date_trunc("day", moment - back)) + back + F.expr("interval 1 day")


def kickoff_utc(day: Column, clock: Column, zone: str = ZONE, defaults: dict[int, str] = DEFAULT_KICKOFF) -> Column:
    """A game day and a wall clock 'HH:MM' as UTC, daylight saving minded; without a clock the weekday's usual one, else 13:00.

    Of a clock time that comes twice as clocks go back the later is meant, so a kickoff is never too early; one that clocks skip as they go forward is read as before the change.
    """
    usual = F.lit("13:00")
    for weekday, at in sorted(defaults.items()):
        usual = F.when(F.dayofweek(day) == weekday, at).otherwise(usual)
    text = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.coalesce(clock, usual))
    local, day_after = F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm")), F.expr("interval 1 day")
    wall = lambda utc: F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    second = local - (wall(first + day_after) - (first + day_after))  # at the offset of the next day
    return F.when(wall(second) == local, second).otherwise(first)


def game_end(kickoff: Column, end: Column, guessed: Column, hours: float = 4.0, late_hours: float = 8.0) -> Column:
    """When a game is surely over: its known end, else the kickoff plus `hours`; for a guessed kickoff at least late_hours after it, so that an error is late, never early."""
    after = lambda h: kickoff + F.expr(f"interval {round(h * 3600)} second")
    return F.when(F.coalesce(guessed, F.lit(True)), F.greatest(end, after(late_hours))).otherwise(F.coalesce(end, after(hours)))


def implied_totals(spread: Column, total: Column) -> tuple[Column, Column]:
    """Points that the market expects of home and away: the halves of total plus and minus spread (positive: home favoured)."""
    return (total + spread) / 2, (total - spread) / 2


def weeks(games: DataFrame, season: str, week: str, day: str, hour: int = WEEKLY_HOUR) -> DataFrame:
    """One row a season and week: first and last game day, as_of, the window (opens, as_of] in which a row belongs to it, neighbours,
    n_games, and days (a week of more than 7 is split)."""
    per = games.groupBy(season, week).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_games"))
    per = per.withColumn("as_of", weekly_as_of(F.col("first_day"), hour))
    w = Window.partitionBy(season).orderBy(week)  # a season has few weeks, whatever its games
    return per.withColumns({"opens": F.lag("as_of").over(w), "previous": F.lag(week).over(w), "following": F.lead(week).over(w), "days": F.date_diff("last_day", "first_day") + 1})


def week_of(points: DataFrame, at: str, calendar: DataFrame, season: str, week: str) -> DataFrame:
    """points (with the season) and the week whose window (opens, as_of] holds `at`: the first week also holds all before it; after the last, null."""
    c = calendar.groupBy(season).agg(F.array_sort(F.collect_list(F.struct("as_of", F.col(week).alias("w")))).alias("_weeks"))
    first = F.get(F.filter("_weeks", lambda x: x["as_of"] >= F.col(at)), F.lit(0))
    return points.join(c, season, "left").withColumn(week, first["w"]).drop("_weeks")


def as_of_of(calendar: DataFrame, season: str, week: str, at: tuple[int, int]) -> DataFrame:
    """The as_of of one week: a point lookup."""
    return calendar.where((F.col(season) == at[0]) & (F.col(week) == at[1])).select("as_of")


def week_at(calendar: DataFrame, at: Column) -> DataFrame:
    """The latest week whose list was made at or before a moment."""
    return calendar.where(F.col("as_of") <= at).orderBy(F.col("as_of").desc()).limit(1)


def season_end(calendar: DataFrame, season: str) -> DataFrame:
    """Per season the moment after which its weeks are all over: the last as_of."""
    return calendar.groupBy(season).agg(F.max("as_of").alias("as_of"))


def regime(rows: DataFrame, season: str, key: list[str], played: str, listed: str, most: float = 0.05) -> DataFrame:
    """Per season how its lists were taken: 'game_day' if hardly any that played wasn't listed (any of its rows), else 'post_game'."""
    per = rows.groupBy(season, *key).agg(F.bool_or(played).alias("p"), F.bool_or(listed).alias("l"))
    odd = F.count_if(F.col("p") & ~F.coalesce("l", F.lit(False)))
    share = (odd / F.nullif(F.count_if("p"), F.lit(0))).alias("share")
    return per.groupBy(season).agg(share).withColumn("regime", F.when(F.col("share") <= most, "game_day").otherwise("post_game"))
