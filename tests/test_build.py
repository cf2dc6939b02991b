"""Casts, assertions, corrections, versions, sources and sinks, scores, lineups."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import availability, build, calendar, careers, league, plays, pool, windows
from tidemark.sources import tables


def test_casts_fail_aloud(spark):
    x = spark.createDataFrame([(1.0, "7", " "), (None, "8", "q")], "a double, s string, e string")
    got = x.select(build.strict_cast(x, "a", "int").alias("a"), build.strict_cast(x, "s", "bigint").alias("s"), build.strict_cast(x, "e", "string").alias("e")).collect()
    assert [tuple(r) for r in got] == [(1, 7, None), (None, 8, "q")]
    for frame, column in ((x.withColumn("a", F.lit(1.5)), "a"), (x.withColumn("s", F.lit("x")), "s")):
        with pytest.raises(Exception, match="whole number|CAST_INVALID"):
            frame.select(build.strict_cast(frame, column, "int")).collect()


def test_keys_and_corrections_are_checked(spark):
    x = spark.createDataFrame([("a", 1, "old"), ("a", 5, "old"), (None, 2, "old")], "k string, t int, v string")
    assert build.assert_key(x, ["k", "t"], []).count() == 3
    with pytest.raises(ValueError, match="null"):
        build.assert_key(x, ["k", "t"])
    with pytest.raises(ValueError, match="repeat"):
        build.assert_key(x.unionAll(x), ["k", "t"], [])
    fix = spark.createDataFrame([("a", 1, 3, "new")], "k string, first int, last int, value string")
    assert {(r.t, r.v, r.is_corrected) for r in build.corrected(x, fix, ["k"], "t", "v").collect()} == {(1, "new", True), (5, "old", False), (2, "old", False)}
    with pytest.raises(ValueError, match="overlap"):
        build.corrected(x, fix.unionAll(fix.withColumn("first", F.lit(2))), ["k"], "t", "v")
    out, seen = build.materialized(x.unionAll(x), ["k", "t"], [F.col("v")], ["k"], distinct=True)
    assert out.count() == 2 and seen.get == {"staged": 3, "without_key": 1}


def test_versions_are_whole(spark, tmp_path):
    v = build.Versions(spark, f"file://{tmp_path}/db")
    x = spark.range(5)
    first = v.build({"t": x, "u": x})
    with pytest.raises(Exception):
        v.build({"t": x, "u": x.select(F.raise_error(F.lit("no")).alias("e"))})
    assert v.current() == first and v.read("u").count() == 5
    second = v.build({"t": spark.range(7)}, {"t": ["id"]})
    assert v.current() == second and v.read("t").count() == 7
    commented = build.commented(x, {"id": "the key"})
    assert commented.schema["id"].metadata["comment"] == "the key" and build.empty(spark, x.schema).count() == 0


def test_sources_by_season_and_layout(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{root}/d_2001.parquet")
    spark.createDataFrame([(1.5, "x")], "a double, c string").write.parquet(f"{root}/d_2002.parquet")
    paths = tables.resolved(spark, root, "d", [2000, 2001, 2002], first=2001)
    with pytest.raises(FileNotFoundError, match="2003, 2004"):
        tables.resolved(spark, root, "d", [2002, 2003, 2004])
    both = tables.by_season(spark, paths)
    assert {tuple(r) for r in both.select("a", "b", "c", "season").collect()} == {(1.0, 2, None, 2001), (1.5, None, "x", 2002)}
    assert tables.split_by_layout(spark, paths.values(), "b") == ([paths[2001]], [paths[2002]])
    assert tables.n_rows(spark, paths[2001]) == 1 and spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert tables.attached(spark, root, ["d_2001.parquet"], "w_") == ["w_d_2001"] and spark.table("w_d_2001").count() == 1


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(1, "a|b"), (2, None)], "as_of int, v string")
    path = f"file://{tmp_path}/snap"
    assert tables.append_snapshot(x, path) == 2 and tables.append_snapshot(x.withColumn("v", F.lit("changed")), path) == 0
    assert tables.append_snapshot(x.withColumn("as_of", F.col("as_of") + 1), path) == 1
    assert {(r.as_of, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a|b"), (2, None), (3, None)}
    tables.replace_atomically(x, f"file://{tmp_path}/t")
    tables.replace_atomically(x.limit(1), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1 and len(list(tmp_path.glob("t*"))) == 1
    assert tables.report(x.orderBy("as_of"), "csv") == "as_of,v\n1,a|b\n2,\n"
    assert "a\\|b" in tables.report(x, "markdown") and "<td>a|b</td>" in tables.report(x, "html")
    with pytest.raises(ValueError):
        tables.report(x, "csv", most=1)
    kept = tables.Artifacts(spark, f"file://{tmp_path}/models")
    pin = kept.save("m", {"b": 1, "a": [1.5]})
    assert kept.load("m", pin) == {"a": [1.5], "b": 1}
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert tables.config(spark, f"{tmp_path}/c.json", {"a": int}) == {"a": 1}
    with pytest.raises(ValueError):
        tables.config(spark, f"{tmp_path}/c.json", {"a": str})


def test_scores_refuse_missing_stats(spark):
    x = spark.createDataFrame([(2.0, None)], "a double, b double")
    assert scoring.score(x, {"a": 3, "b": 1}, breakdown=True).first().asDict() == {"a": 2.0, "b": None, "points": 6.0, "points_a": 6.0, "points_b": 0.0}
    with pytest.raises(ValueError, match="c"):
        scoring.score(x, {"c": 1})
    assert x.select(scoring.tier_points(F.col("a"), [(1, 10), (2, 7), (None, -4)]), scoring.tier_points(F.col("b"), [(1, 10), (None, 1)])).first()[:] == (7.0, 0.0)


def brute_lineup(players, slots):
    best = 0.0
    for k in range(len(slots) + 1):
        for chosen in itertools.permutations(players, k):
            for at in itertools.combinations(range(len(slots)), k):
                if all(p[1] in slots[s][1] for p, s in zip(chosen, at, strict=True)):
                    best = max(best, sum(p[2] for p in chosen))
    return best


def test_lineups_against_brute_force():
    r = random.Random(3)
    slots = [("A", frozenset("A")), ("B", frozenset("B")), ("F", frozenset("AB"))]
    for _ in range(60):
        players = [(k, r.choice("ABC"), round(r.uniform(-3, 9), 1)) for k in range(r.randint(0, 6))]
        found = league.best_lineup(players, slots)
        points = {k: p for k, _, p in players}
        assert len({p for _, p in found}) == len(found) == len({s for s, _ in found})
        assert abs(sum(points[p] for _, p in found) - brute_lineup(players, slots)) < 1e-9


def test_places_of_skewed_and_null_groups(spark):
    rows = [("a", float(k % 7)) for k in range(500)] + [("b", 1.0)] * 3 + [(None, 2.0), (None, None), ("c", -1e9), ("c", 1e9)]
    x = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "i int, g string, v double")
    got = {r.i: (r.n, r.below, r.of) for r in windows.with_places(x, "v", ["g"]).collect()}
    for i, (g, v) in enumerate(rows):
        own = [w for h, w in rows if h == g and w is not None]
        assert got[i] == ((None, None, None) if v is None else (own.count(v), sum(w < v for w in own), len(own)))
    assert {r.i: r.rn for r in windows.ordinal(x.where("g = 'b'"), "v", "i", ["g"], descending=True).collect()} == {500: 1, 501: 2, 502: 3}
    q = {r.g: (r.lo, r.mid) for r in windows.quantiles(x.where("g is not null"), "v", ["g"], {"lo": 0.25}, {"mid": 0.5}).collect()}
    assert q == {"a": (1.0, 3.0), "b": (1.0, 1.0), "c": (-1e9, 0.0)}


def test_quantiles_between_values_weigh_both(spark):
    x = spark.createDataFrame([(v,) for v in (2270.79, 88080.53)], "v double").withColumn("g", F.lit(1))
    assert windows.quantiles(x, "v", ["g"], {}, {"mid": 0.5}).first().mid == 45175.659999999996


def test_places_of_many_values_read_one_set_of_ranges(spark):
    x = spark.range(0, 60_000, 1, 16).select("id", F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    places = windows.placed(x, "v", ["g"])
    assert "percentile_approx" not in places._jdf.queryExecution().toString()  # the ranges aren't computed anew by each of their readers
    plain = x.groupBy("g", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy("v")
    plain = plain.select("g", "v", "n", (F.sum("n").over(w) - F.col("n")).alias("below"), F.sum("n").over(Window.partitionBy("g")).alias("of"))
    assert plain.exceptAll(places).isEmpty() and places.exceptAll(plain).isEmpty()


def test_finishes_are_ranks(spark):
    x = spark.range(0, 20_000, 1, 8).select("id", F.pmod(F.xxhash64("id"), F.lit(9_000)).cast("double").alias("score"), (F.col("id") % 3).alias("week"), (F.col("id") % 2).alias("pos"))
    found = pool.finishes(x, ["week"], "pos", "score", {"top3": 3})
    assert "percentile_approx" not in found._jdf.queryExecution().toString()
    w = Window.partitionBy("week", "pos")
    plain = x.withColumn("finish", F.rank().over(w.orderBy(F.col("score").desc())).cast("long")).withColumn("of", F.count("*").over(w)).withColumn("top3", F.col("finish") <= 3)
    found = found.select(*plain.columns)
    assert plain.exceptAll(found).isEmpty() and found.exceptAll(plain).isEmpty()


def test_kickoffs_as_clocks_change(spark):
    sun = dt.date(1999, 10, 31)  # 02:00 EDT became 01:00 EST
    days = [(sun, "00:30", 4), (sun, "01:00", 6), (sun, "01:30", 6), (sun, "02:00", 7), (dt.date(1999, 10, 30), "23:30", 27), (dt.date(1999, 4, 4), "01:30", 6), (dt.date(1999, 4, 4), "02:30", 7), (dt.date(1999, 4, 3), "12:00", 17)]
    x = spark.createDataFrame([(d, c) for d, c, _ in days], "day date, clock string")
    got = [r.k for r in x.select(calendar.kickoff_utc(F.col("day"), F.col("clock")).alias("k")).collect()]
    assert got == [dt.datetime.combine(d, dt.time(0, int(c[3:]))) + dt.timedelta(hours=h) for d, c, h in days]


def test_availability_is_complete_and_lookups_unique(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    times = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 2))], "j int, t timestamp_ntz")
    look = availability.Lookup(times.limit(1), {"id": "j"}, ("t",))
    rules = availability.Rules((availability.Branch("known", F.col("t").isNotNull(), F.col("t")),), (look,))
    assert availability.Lookup(times, {"id": "j"}, ("t",)).repeated().count() == 1 and look.repeated().isEmpty()
    with pytest.raises(ValueError, match="without availability"):
        availability.complete(rules.apply(x))
    assert availability.complete(rules.apply(x.where("id = 1"))).first().branch == "known"


def test_calendar_edges(spark):
    x = spark.sql("select date'2024-11-05' tue, date'2024-07-07' sun, timestamp_ntz'2024-01-01 10:00:00' t")
    r = x.select(calendar.weekly_as_of(F.col("tue")), calendar.kickoff_utc(F.col("sun"), F.lit(None).cast("string")), calendar.kickoff_utc(F.col("tue"), F.lit("20:15")), calendar.next_nightly(F.col("t"))).first()
    assert r[:] == (dt.datetime(2024, 11, 12, 14), dt.datetime(2024, 7, 7, 17), dt.datetime(2024, 11, 6, 1, 15), dt.datetime(2024, 1, 2, 10))


def test_decisions_and_careers_edges(spark):
    x = spark.createDataFrame([(0.5, 0.5, None), (None, None, None), (None, 0.1, None)], "a double, b double, c double")
    d = plays.decided({n: F.col(n) for n in "abc"})
    assert [tuple(r) for r in x.select(*[c.alias(n) for n, c in d.items()]).collect()] == [("a", 0.5, "b", 0.0, "toss-up"), (None, None, None, None, None), ("b", 0.1, None, None, "only option")]
    odds = spark.createDataFrame([(-110, -110), (150, -170), (None, 100)], "h int, a int").select(careers.moneyline_prob(F.col("h"), F.col("a")).alias("p")).collect()
    assert odds[0].p == 0.5 and abs(odds[1].p - 0.4 / (0.4 + 170 / 270)) < 1e-12 and odds[2].p is None
    with pytest.raises(Exception, match="overlap|first"):
        build.corrected(spark.createDataFrame([("a", 1, "v")], "k string, t int, v string"), spark.createDataFrame([("a", 1, 9, "x"), ("a", 2, 3, "y")], "k string, first int, last int, value string"), ["k"], "t", "v")
