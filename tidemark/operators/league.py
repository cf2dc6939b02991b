"""A fantasy league: lineups, schedules, odds, regret, rule checks; and the lists that a site serves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import exact_sum, ratio
from tidemark.functions.resample import drawn


def best_lineup(players: Sequence[tuple[object, str, float]], slots: Sequence[tuple[str, frozenset[str]]]) -> list[tuple[str, object]]:
    """(slot, player) of the lineup with most points, by dynamic programming over which slots are filled: a state keeps its best, ties to
    the players that come first. A slot that no one can fill stays empty; nobody is needed with negative points."""
    order = sorted(players, key=lambda p: (-p[2], str(p[0])))
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for who, position, points in order:
        for mask, (total, held) in list(best.items()):
            for k, (_, fits) in enumerate(slots):
                if position in fits and not mask >> k & 1 and points > 0:
                    new = (total + points, (*held, (k, who)))
                    if mask | 1 << k not in best or new[0] > best[mask | 1 << k][0] + 1e-12:
                        best[mask | 1 << k] = new
    return [(slots[k][0], who) for k, who in sorted(max(best.values(), key=lambda x: x[0])[1])]


def lineups(rosters: DataFrame, by: list[str], player: str, position: str, points: str, slots: Mapping[str, Sequence[str]]) -> DataFrame:
    """(by, slot, player): each group's best lineup. A group is a roster, a few dozen rows by the league's rules."""
    wanted = [(s, frozenset(p)) for s, p in slots.items()]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(frame[player], frame[position], frame[points], strict=True))
        found = best_lineup(rows, wanted)
        out = pd.DataFrame({"slot": [s for s, _ in found], player: [p for _, p in found]})
        for b in reversed(by):
            out.insert(0, b, frame[b].iloc[0])
        return out

    kinds = dict(rosters.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "slot string", f"{player} {kinds[player]}"])
    return rosters.select(*by, player, position, points).groupBy(*by).applyInPandas(solve, schema)


def swapped(scores: DataFrame, team: str, week: str, points: str, opponent: str) -> DataFrame:
    """(team, with_schedule_of, wins): each team's record had it played another's schedule. A week meets once, so pairs are of teams, not of rows."""
    mine = scores.select(F.col(team).alias("a"), F.col(week).alias("w"), F.col(points).alias("x"), F.col(opponent).alias("own"))
    theirs = scores.select(F.col(team).alias("b"), F.col(week).alias("w"), F.col(opponent).alias("versus"))
    faced = mine.join(theirs, "w").withColumn("versus", F.when(F.col("versus") == F.col("a"), F.col("b")).otherwise(F.col("versus")))
    held = scores.select(F.col(team).alias("versus"), F.col(week).alias("w"), F.col(points).alias("y"))
    won = F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0)
    return faced.join(held, ["versus", "w"]).groupBy(F.col("a").alias(team), F.col("b").alias("with_schedule_of")).agg(F.sum(won).alias("wins"))


def shrunk_means(scores: DataFrame, team: str, points: str, k: float) -> DataFrame:
    """Mean points of a team, drawn to the league's by k games."""
    league = scores.agg(F.avg(points).alias("_league"))
    per = scores.groupBy(team).agg(F.sum(points).alias("_s"), F.count("*").alias("games"))
    return per.crossJoin(league).select(team, "games", ((F.col("_s") + F.lit(float(k)) * F.col("_league")) / (F.col("games") + F.lit(float(k)))).alias("mean"))


def odds(means: DataFrame, residuals: DataFrame, games: DataFrame, wins: DataFrame, team: str, sims: int, places: int, seed: int) -> DataFrame:
    """(team, odds, wins): chance to end among the first `places`, and expected wins, over `sims` seasons. A simulated score is the team's
    mean plus a past residual (i, r; i from 0) drawn by hash of simulation, game and team; games: game, a, b. Simulations spread over the cluster."""
    n = residuals.agg(F.count("*").alias("_n"))
    each = games.crossJoin(n).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    for side in ("a", "b"):
        pick = drawn(seed, F.col("sim"), F.concat_ws("-", F.col("game").cast("string"), F.col(side).cast("string")), F.col("_n"))
        m = means.select(F.col(team).alias(side), F.col("mean").alias(f"_m{side}"))
        r = residuals.select(F.col("i").alias(f"_i{side}"), F.col("r").alias(f"_r{side}"))
        each = each.join(m, side).withColumn(f"_i{side}", pick).join(r, f"_i{side}")
    x, y = F.col("_ma") + F.col("_ra"), F.col("_mb") + F.col("_rb")
    won = F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)
    sides = each.select("sim", F.inline(F.array(F.struct(F.col("a").alias(team), won.alias("w")), F.struct(F.col("b").alias(team), (1 - won).alias("w")))))
    total = sides.groupBy("sim", team).agg(F.sum("w").alias("w")).join(wins.select(team, F.col("wins").alias("_before")), team).withColumn("w", F.col("w") + F.col("_before"))
    place = F.row_number().over(Window.partitionBy("sim").orderBy(F.col("w").desc(), team))
    return total.withColumn("_place", place).groupBy(team).agg((F.count_if(F.col("_place") <= places) / F.lit(float(sims))).alias("odds"), F.avg("w").alias("wins"))


def regret(started: DataFrame, best: DataFrame, by: list[str], player: str, points: str) -> DataFrame:
    """Per group: points of the lineup that was set, of the best one, and what lies between."""
    a = started.groupBy(*by).agg(exact_sum(points).alias("actual"))
    b = best.groupBy(*by).agg(exact_sum(points).alias("optimal"))
    return a.join(b, by).withColumn("regret", F.col("optimal") - F.col("actual"))


def explained(rows: DataFrame, base: str, theirs: str, flips: Mapping[str, Column], most: int) -> DataFrame:
    """Rule flips (name: points that the flip adds) that make our points closest to theirs: every set of up to `most`, its mean absolute error, best first, smaller sets before larger. Sets are few; rows are read once."""
    sets = [s for k in range(most + 1) for s in combinations(flips, k)]
    errors = [F.round(F.avg(F.abs(sum((flips[f] for f in s), F.col(base)) - F.col(theirs))), 6).alias(f"e{i}") for i, s in enumerate(sets)]
    one = rows.agg(*errors)
    pairs = F.array(*[F.struct(F.lit(",".join(s)).alias("flips"), F.lit(len(s)).alias("size"), F.col(f"e{i}").alias("error")) for i, s in enumerate(sets)])
    return one.select(F.inline(pairs))


def merged_flex(lists: Sequence[DataFrame], entity: str, score: str, n: int) -> DataFrame:
    """Lists of several positions as one, ranked again, the first n."""
    whole = lists[0]
    for one in lists[1:]:
        whole = whole.unionByName(one)
    first = whole.orderBy(F.col(score).desc_nulls_last(), entity).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), entity)))


def coverage(rows: DataFrame, by: str, value: str, low: str, high: str) -> DataFrame:
    """Shares of values inside, below and above their range, by group and over all, in one pass."""
    v = F.col(value)
    share = lambda c, name: F.round(F.avg(c.cast("double")), 9).alias(name)
    x = rows.rollup(by).agg(F.grouping(by).alias("_g"), F.count("*").alias("n"), share(v.between(F.col(low), F.col(high)), "inside"), share(v < F.col(low), "below"), share(v > F.col(high), "above"))
    return x.select(F.when(F.col("_g") == 1, "All").otherwise(F.col(by).cast("string")).alias(by), "n", "inside", "below", "above")


def latest_snapshot(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows of the newest snapshot of each list."""
    newest = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(at).alias("_at"))
    same = F.col(at) == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(newest, same, "left_semi")


def changes(published: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """What an upsert writes: fresh rows whose key is new, or whose values differ from the published ones; (row, change)."""
    cols = [c for c in fresh.columns if c not in key]
    old = published.select(*[F.col(k).alias(f"_{k}") for k in key], F.struct(*cols).alias("_old"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = fresh.withColumn("_new", F.struct(*cols)).join(old, same, "left")
    change = F.when(F.col("_old").isNull(), "insert").when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
    return both.withColumn("change", change).where("change is not null").select(*fresh.columns, "change")


def list_state(rows: DataFrame, by: list[str], entity: str, place: str) -> DataFrame:
    """Each list as one ordered array of its entities."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, entity))), lambda x: x[entity]).alias("entities"))


def live_plan(data: DataFrame, published: DataFrame, by: list[str], complete: str, replace: bool = False) -> DataFrame:
    """What to do with each list (entities): publish a new one, skip an equal one, freeze one that differs (or replace it, if told to), refuse an incomplete one."""
    old = published.select(*by, F.col("entities").alias("_old"))
    both = data.join(old, by, "left")
    differs = F.lit("replace" if replace else "freeze")
    what = F.when(~F.col(complete), "incomplete").when(F.col("_old").isNull(), "publish").when(F.col("_old") == F.col("entities"), "skip").otherwise(differs)
    return both.select(*by, what.alias("action"))


def allocated(events: DataFrame, cells: DataFrame, by: list[str], role: str, amount: str) -> DataFrame:
    """A vacated amount dealt to the roles of its group by their shares, clipped to what is there."""
    return events.join(cells, by).select(*events.columns, role, F.least(F.col(amount) * F.col("share"), F.col(amount)).alias("gain"))


def allocation_cells(rows: DataFrame, by: list[str], role: str, got: str, pseudo: float) -> DataFrame:
    """Shares of roles in their group, each drawn to the role's overall share by a pseudo amount."""
    role_all = rows.groupBy(role).agg(F.sum(got).alias("_r"))
    whole = rows.agg(F.sum(got).alias("_w"))
    base = role_all.crossJoin(whole).select(F.col(role).alias("_role"), ratio(F.col("_r"), F.col("_w")).alias("_p"))
    per = rows.groupBy(*by, role).agg(F.sum(got).alias("_got"))
    group = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum(got).alias("_total"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    out = per.join(group, same).join(base, F.col(role) == F.col("_role"))
    return out.select(*by, role, ((F.col("_got") + F.lit(float(pseudo)) * F.col("_p")) / (F.col("_total") + F.lit(float(pseudo)))).alias("share"))
