"""Careers of coaches and players: markets, records, stints, hazards, seasons, ages, boards, tendencies, signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio, sigmoid
from tidemark.operators import windows


def moneyline_prob(home: Column, away: Column) -> Column:
    """Chance of home by American odds, the bookmaker's margin taken out; null without both."""
    implied = lambda m: F.when(m < 0, -m / (-m + 100)).when(m > 0, F.lit(100.0) / (m + 100))
    return implied(home) / (implied(home) + implied(away))


def slope(df: DataFrame, x: str, won: str, steps: int = 12) -> float:
    """b of P(won) = sigmoid(b * x) by Newton's method: two sums a step, whatever the number of rows."""
    b, xs, y = 0.0, F.col(x).cast("double"), F.col(won).cast("double")
    for _ in range(steps):
        fit = sigmoid(F.lit(b) * xs)
        g, h = df.agg(F.sum((y - fit) * xs), F.sum(fit * (1 - fit) * xs * xs)).first()
        if not h:
            break
        b += g / h
    return b


def pythagorean(scored: Column, allowed: Column, exponent: float = 2.37) -> Column:
    """Share of games that a team with these points should win."""
    a, b = F.pow(scored, F.lit(exponent)), F.pow(allowed, F.lit(exponent))
    return ratio(a, a + b)


def sides(games: DataFrame, home: dict[str, str], away: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Two rows a game, one for each side: {column of the result: column of games} for home and for away."""
    pair = F.array(F.struct(F.lit(True).alias("is_home"), *[F.col(c).alias(n) for n, c in home.items()]), F.struct(F.lit(False).alias("is_home"), *[F.col(c).alias(n) for n, c in away.items()]))
    return games.select(*keep, F.inline(pair))


def records(rows: DataFrame, team: str, season: str, scored: str, allowed: str) -> DataFrame:
    """Wins (ties half), games, share of games won, by team and season."""
    won = F.when(F.col(scored) > F.col(allowed), 1.0).when(F.col(scored) == F.col(allowed), 0.5).otherwise(0.0)
    per = rows.groupBy(team, season).agg(F.sum(won).alias("wins"), F.count("*").alias("games"), F.sum(scored).alias("scored"), F.sum(allowed).alias("allowed"))
    return per.withColumn("share", F.col("wins") / F.col("games"))


def tenure(seasons: DataFrame, team: str, season: str, coach: str, share: str, first_season: int) -> DataFrame:
    """One row a team and season with how long its coach has been there without a break (years), how many losing seasons in a row before
    this one, whether he took over this season, and whether the run began before the data does (censored)."""
    runs = windows.islands(seasons.withColumn("_gap", F.col(season) - F.row_number().over(Window.partitionBy(team).orderBy(season))).withColumn("_who", F.struct(coach, "_gap")), [team], [season], "_who")
    run = Window.partitionBy(team, "island").orderBy(season)
    winning = F.max(F.when(F.col(share) >= 0.5, F.col(season))).over(run.rowsBetween(Window.unboundedPreceding, -1))
    start = F.min(season).over(Window.partitionBy(team, "island"))
    out = runs.withColumns({"years": F.row_number().over(run).cast("long"), "_start": start, "_won": winning})
    losing = F.col(season) - F.coalesce(F.col("_won"), F.col("_start") - 1) - 1
    return out.withColumns({"losing": losing.cast("long"), "took_over": F.col("years") == 1, "censored": F.col("_start") == first_season}).drop("_gap", "_who", "_start", "_won", "island")


def trend(plays: DataFrame, team: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of `value` over all of a team's rows and over its last n games, and their difference."""
    game = plays.groupBy(team, *order).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    k = F.row_number().over(windows.backward([team], order))
    late = lambda c: F.sum(F.when(F.col("_k") <= n, F.col(c)))
    per = game.withColumn("_k", k).groupBy(team).agg(ratio(F.sum("_s"), F.sum("_n")).alias("season"), ratio(late("_s"), late("_n")).alias("late"))
    return per.withColumn("trend", F.col("late") - F.col("season"))


def remaining(played: DataFrame, team: str, cancelled: DataFrame) -> DataFrame:
    """Games that each team has left: those of the longest schedule, less its own and its cancelled ones."""
    per = played.groupBy(team).agg(F.count("*").alias("played"))
    longest = per.agg(F.max("played").alias("_most"))  # one row
    off = cancelled.groupBy(F.col(team).alias("_t")).agg(F.count("*").alias("_off"))
    out = per.crossJoin(longest).join(off, F.col(team) == F.col("_t"), "left")
    return out.select(team, "played", (F.col("_most") - F.col("played") - F.coalesce("_off", F.lit(0))).alias("remaining"))


def season_risk(rows: DataFrame, key: str, left: str, hazard) -> DataFrame:
    """Chance that the event comes in any of the intervals left: each row stands for left, left - 1, ..., 0, hazard(column) is the chance in
    each, and 1 - product(1 - h) their union. The product is a sum of logarithms, so it spreads."""
    each = rows.withColumn("_g", F.explode(F.sequence(F.col(left), F.lit(0))))
    return each.groupBy(key).agg((1 - F.exp(F.sum(F.log1p(-hazard(F.col("_g")))))).alias("risk"), F.count("*").alias("intervals"))


def hazard_targets(rows: DataFrame, events: DataFrame, key: str, at: str, ends: str, kinds: Sequence[str]) -> DataFrame:
    """rows (key, at, next row's or season's end) with label: did an event of `kinds` come after `at` and by `ends`; rows whose interval
    holds an event of another kind are censored (null), rows after a key's first event are dropped."""
    first = events.groupBy(F.col(key).alias("_k")).agg(F.min_by("kind", "day").alias("_kind"), F.min("day").alias("_day"))
    out = rows.join(first, F.col(key) == F.col("_k"), "left").where(F.col("_day").isNull() | (F.col(at) < F.col("_day")))
    inside = F.coalesce((F.col("_day") > F.col(at)) & (F.col("_day") <= F.col(ends)), F.lit(False))
    label = F.when(inside & ~F.col("_kind").isin(*kinds), F.lit(None).cast("boolean")).otherwise(inside)
    return out.withColumn("label", label).drop("_k", "_kind", "_day")


def season_ranks(seasons: DataFrame, season: str, group: str, value: str, games: str, least: int) -> DataFrame:
    """seasons with `place` among those of their season and group with enough games; the others have none."""
    w = Window.partitionBy(season, group, F.col(games) >= least).orderBy(F.col(value).desc())
    return seasons.withColumn("place", F.when(F.col(games) >= least, F.rank().over(w)))


def quadratic(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least squares of y on 1, x, x^2 by group, in closed form from sums: a, b, c of a + b x + c x^2. Null with fewer than three places of x."""
    v, t = F.col(x).cast("double"), F.col(y).cast("double")
    names = {f"s{k}": F.sum(F.pow(v, k)) for k in range(5)} | {f"t{k}": F.sum(F.pow(v, k) * t) for k in range(3)}
    s = df.where(v.isNotNull() & t.isNotNull()).groupBy(by).agg(*[e.alias(n) for n, e in names.items()], F.count_distinct(x).alias("places"))
    c = {n: F.col(n) for n in names}
    s0, s1, s2, s3, s4, t0, t1, t2 = (c[n] for n in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    da = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    db = s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
    dc = s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)
    ok = F.col("places") >= 3
    return s.select(by, *[F.when(ok, d / det).alias(n) for n, d in (("a", da), ("b", db), ("c", dc))])


def disagreements(df: DataFrame, group: str, entity: str, mine: str, theirs: str, top: int) -> DataFrame:
    """Two rankings side by side: per row both places, their gap, and which tops it is in: both, model_only, other_only, or null."""
    place = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.col(c).desc_nulls_last(), entity))
    out = df.withColumns({"mine_place": place(mine), "their_place": place(theirs)})
    a, b = F.col("mine_place") <= top, F.col("their_place") <= top
    return out.withColumns({"gap": F.col("their_place") - F.col("mine_place"), "member": F.when(a & b, "both").when(a, "model_only").when(b, "other_only")})


def prior_counts(rows: DataFrame, entity: str, order: list[str], event: str) -> DataFrame:
    """rows with how often the entity was there before, and how often with the event."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"n_before": F.count("*").over(w), "events_before": F.coalesce(F.sum(F.col(event).cast("long")).over(w), F.lit(0))})


def nested_rates(rows: DataFrame, levels: Sequence[str], label: str, k: float) -> DataFrame:
    """(depth, levels, n, rate): rates of nested groups, each shrunk to its parent's by k rows; depth 0 is the whole."""
    counts = rows.groupBy(*levels).agg(F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    parent = counts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(F.lit(0).alias("depth"), "n", ratio(F.col("s"), F.col("n")).alias("rate"))
    out = parent
    for d in range(1, len(levels) + 1):
        own, above = list(levels[:d]), list(levels[: d - 1])
        up = parent.select(*above, F.col("rate").alias("_up"))
        part = counts.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        part = part.join(up, above) if above else part.crossJoin(up)
        parent = part.select(F.lit(d).alias("depth"), *own, "n", ((F.col("s") + F.lit(float(k)) * F.col("_up")) / (F.col("n") + F.lit(float(k)))).alias("rate"))
        out = out.unionByName(parent, allowMissingColumns=True)
    return out.select("depth", *levels, "n", "rate")


def predict_nested(rows: DataFrame, table: DataFrame, levels: Sequence[str]) -> DataFrame:
    """rows with the rate of their deepest group that the table has; null levels are values like others."""
    out, found = rows, []
    for d in range(len(levels), -1, -1):
        cell = table.where(F.col("depth") == d).select(*[F.col(c).alias(f"_{c}") for c in levels[:d]], F.col("rate").alias(f"_r{d}"))
        same = F.lit(True)
        for c in levels[:d]:
            same = same & out[c].eqNullSafe(F.col(f"_{c}"))
        out = out.join(cell, same, "left").drop(*[f"_{c}" for c in levels[:d]])
        found.append(F.col(f"_r{d}"))
    return out.select(*rows.columns, F.coalesce(*found).alias("rate"))


def crossings(values: DataFrame, entity: str, at: str, value: str, threshold: float, base: str) -> DataFrame:
    """First time an entity's value is at or above the threshold, of those whose baseline (value at or before `base`) is below it."""
    before = F.col(at) <= F.to_timestamp_ntz(F.lit(base))
    per = values.groupBy(entity).agg(F.max_by(value, F.when(before, F.col(at))).alias("baseline"), F.min(F.when(~before & (F.col(value) >= threshold), F.col(at))).alias("crossed"))
    return per.where(F.coalesce(F.col("baseline") < threshold, F.lit(True)) & F.col("crossed").isNotNull())


def momentum(values: DataFrame, entity: str, period: str, value: str, rise: float) -> DataFrame:
    """First period of each entity in which its value is up by `rise` or more on the very period before."""
    w = Window.partitionBy(entity).orderBy(period)
    up = (F.lag(period).over(w) == F.col(period) - 1) & (F.col(value) - F.lag(value).over(w) >= rise)
    return values.withColumn("_up", up).where("_up").groupBy(entity).agg(F.min(period).alias("flagged"))


def leads(flags: DataFrame, adds: DataFrame, entity: str, flagged: str, added: str) -> DataFrame:
    """Per entity that either has: flag and add, the lead between them, and what it is: early, same, late, never added, never flagged."""
    both = flags.select(entity, flagged).join(adds.select(entity, added), entity, "full")
    lead = F.col(added) - F.col(flagged)
    what = F.when(F.col(added).isNull(), "never added").when(F.col(flagged).isNull(), "never flagged").when(lead > 0, "early").when(lead == 0, "same").otherwise("late")
    return both.withColumns({"lead": lead, "category": what})


def pairs_in_order(rows: DataFrame, by: list[str], order: list[str], value: str, ok: Column) -> DataFrame:
    """Differences to the next row of the group where both rows are ok: (by, first, following, gap)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("_ok", ok).withColumns({"_next": F.lead(value).over(w), "_next_ok": F.lead("_ok").over(w)})
    return out.where("_ok and _next_ok").select(*by, F.col(value).alias("first"), F.col("_next").alias("following"), (F.col("_next") - F.col(value)).alias("gap"))


def persistence(rows: DataFrame, entity: str, season: str, value: str) -> DataFrame:
    """(entity, season, value, following): values of consecutive seasons."""
    w = Window.partitionBy(entity).orderBy(season)
    out = rows.withColumns({"_s": F.lead(season).over(w), "following": F.lead(value).over(w)})
    return out.where(F.col("_s") == F.col(season) + 1).select(entity, season, value, "following")
