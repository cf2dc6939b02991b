"""Seasons, weeks, kickoffs and runs over orders and events."""

from pyspark.sql import functions as F

from tidemark.operators import calendar
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_TUESDAY = "CAST(d + to_days(CAST((2 - isodow(d) + 6) % 7 + 1 AS INTEGER)) AS TIMESTAMP) + INTERVAL 14 HOUR"
_GAMES = "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week, CAST(o_orderdate AS DATE) AS day FROM orders"
_WEEKS = f"""SELECT *, lag(as_of) OVER w AS opens, lag(week) OVER w AS previous, lead(week) OVER w AS following, CAST(last_day - first_day + 1 AS INTEGER) AS days
FROM (SELECT season, week, min(day) AS first_day, max(day) AS last_day, count(*) AS n_games, {_TUESDAY.replace("(d)", "(min(day))").replace("CAST(d ", "CAST(min(day) ")} AS as_of FROM ({_GAMES}) GROUP BY season, week) WINDOW w AS (PARTITION BY season ORDER BY week)"""


def games(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.year(d).alias("season"), F.month(d).alias("week"), F.to_date(d).alias("day"))


def weeks(spark, sf_dir):
    return calendar.weeks(games(spark, sf_dir), "season", "week", "day")


@query(f"SELECT o_orderkey, {_TUESDAY} AS as_of FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def weekly_as_of_rule(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.weekly_as_of(F.to_date("o_orderdate")).alias("as_of"))


@query("SELECT event_id, CAST(date_trunc('day', ts - INTERVAL 10 HOUR) AS TIMESTAMP) + INTERVAL 34 HOUR AS run_at FROM events")
def next_nightly_run(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", calendar.next_nightly(F.col("ts")).alias("run_at"))


@query("""SELECT o_orderkey, timezone('UTC', timezone('America/New_York', strptime(strftime(o_orderdate, '%Y-%m-%d') || ' ' || clock, '%Y-%m-%d %H:%M'))) AS kickoff FROM
(SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' ELSE CASE dayofweek(o_orderdate) WHEN 0 THEN '13:00' WHEN 1 THEN '20:15' WHEN 4 THEN '20:20' WHEN 6 THEN '16:30' ELSE '13:00' END END AS clock FROM orders)""")
def kickoff_to_utc(spark, sf_dir):
    clock = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30")))
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.kickoff_utc(F.to_date("o_orderdate"), clock).alias("kickoff"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN greatest(CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 5 HOUR END, l_shipdate + INTERVAL 8 HOUR) ELSE coalesce(CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 5 HOUR END, l_shipdate + INTERVAL 4 HOUR) END AS over_at FROM lineitem""")
def game_end_errs_late(spark, sf_dir):
    end = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("interval 5 hour"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", calendar.game_end(F.col("l_shipdate"), end, F.col("l_returnflag") == "A").alias("over_at"))


@query("SELECT p_partkey, (p_retailprice + p_size) / 2 AS home, (p_retailprice - p_size) / 2 AS away FROM part")
def implied_totals(spark, sf_dir):
    home, away = calendar.implied_totals(F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", home.alias("home"), away.alias("away"))


@query(_WEEKS)
def season_calendar(spark, sf_dir):
    return weeks(spark, sf_dir)


@query(f"""WITH w AS ({_WEEKS}), e AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderdate + to_hours(CAST(o_orderkey % 700 AS INTEGER)) AS at FROM orders)
SELECT e.o_orderkey, min(w.week) AS week FROM e LEFT JOIN w ON e.season = w.season AND w.as_of >= e.at GROUP BY e.o_orderkey""")
def week_of_timestamp(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 700).cast("int"))
    points = o.select("o_orderkey", F.year("o_orderdate").alias("season"), at.alias("at"))
    return calendar.week_of(points, "at", weeks(spark, sf_dir), "season", "week").select("o_orderkey", "week")


@query(f"WITH w AS ({_WEEKS}) SELECT 'lookup' AS what, as_of FROM w WHERE season = 1998 AND week = 7 UNION ALL (SELECT 'week at', as_of FROM w WHERE as_of <= TIMESTAMP '1999-06-30 12:00:00' ORDER BY as_of DESC LIMIT 1) UNION ALL SELECT 'end of ' || season, max(as_of) FROM w GROUP BY season")
def calendar_lookups(spark, sf_dir):
    w = weeks(spark, sf_dir)
    one = calendar.as_of_of(w, "season", "week", (1998, 7)).select(F.lit("lookup").alias("what"), "as_of")
    two = calendar.week_at(w, F.lit("1999-06-30 12:00:00").cast("timestamp_ntz")).select(F.lit("week at").alias("what"), "as_of")
    return one.unionAll(two).unionAll(calendar.season_end(w, "season").select(F.concat(F.lit("end of "), "season").alias("what"), "as_of"))


@query("""WITH p AS (SELECT year(l_shipdate) AS season, l_suppkey, bool_or(l_returnflag = 'R') AS p, bool_or(l_quantity > 49 OR year(l_shipdate) = 1997) AS l FROM lineitem GROUP BY ALL),
s AS (SELECT CAST(season AS INTEGER) AS season, CAST(count(*) FILTER (WHERE p AND NOT l) AS DOUBLE) / nullif(count(*) FILTER (WHERE p), 0) AS share FROM p GROUP BY season) SELECT *, CASE WHEN share <= 0.05 THEN 'game_day' ELSE 'post_game' END AS regime FROM s""")
def snapshot_regime(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"), "l_suppkey", (F.col("l_returnflag") == "R").alias("played"), ((F.col("l_quantity") > 49) | (F.year("l_shipdate") == 1997)).alias("listed"))
    return calendar.regime(x, "season", ["l_suppkey"], "played", "listed")


_RULE = """CASE WHEN o_orderstatus = 'F' THEN greatest(o_orderdate + INTERVAL 1 DAY, last_ship) WHEN o_orderstatus = 'P' THEN coalesce(first_ship, o_orderdate + INTERVAL 9 DAY) ELSE {nightly} END"""


@query(f"""WITH s AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderstatus, {_RULE.format(nightly="CAST(date_trunc('day', o_orderdate - INTERVAL 10 HOUR) AS TIMESTAMP) + INTERVAL 34 HOUR")} AS t,
  CASE WHEN o_orderstatus = 'F' THEN 'shipped' WHEN o_orderstatus = 'P' THEN CASE WHEN first_ship IS NULL THEN 'guessed' ELSE 'first part' END ELSE 'nightly' END AS branch FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT branch, count(*) AS n, min(t) AS first_at, max(t) AS last_at, count(*) FILTER (WHERE t IS NULL) AS n_null FROM r GROUP BY branch""")
def availability_rule_joined(spark, sf_dir):
    """A compiled rule with joined times: the time and the branch it came from, accounted by branch."""
    from tidemark.operators import availability

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    rule = availability.Rules(
        joins=(availability.Lookup(lines, {"o_orderkey": "l_orderkey"}, ("first_ship", "last_ship")),),
        branches=(
            availability.Branch("shipped", F.col("o_orderstatus") == "F", F.greatest(F.col("o_orderdate") + F.expr("interval 1 day"), F.col("last_ship"))),
            availability.Branch("guessed", (F.col("o_orderstatus") == "P") & F.col("first_ship").isNull(), F.col("o_orderdate") + F.expr("interval 9 day")),
            availability.Branch("first part", F.col("o_orderstatus") == "P", F.col("first_ship")),
            availability.Branch("nightly", F.lit(True), calendar.next_nightly(F.col("o_orderdate"))),
        ),
    )
    return availability.account(rule.apply(table(spark, sf_dir, "orders"))).withColumnsRenamed({"first": "first_at", "last": "last_at"})


@query("""WITH f AS (SELECT user_id, min(ts) AS t FROM (SELECT user_id, ts FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, ts + INTERVAL 1 DAY FROM events WHERE event_type = 'purchase') GROUP BY user_id)
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN TIMESTAMP '2024-01-02 00:00:00' ELSE t END AS available_at FROM customer LEFT JOIN f ON c_custkey = user_id""")
def row_visibility(spark, sf_dir):
    """A row of a hindsight table exists from its known date, or from its first public trace in any event table; without either it is never shown."""
    from tidemark.operators import availability

    e = table(spark, sf_dir, "events")
    traces = [e.where("event_type = 'signup'").select("user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", (F.col("ts") + F.expr("interval 1 day")).alias("ts"))]
    known = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("2024-01-02").cast("timestamp_ntz"))
    return availability.visible_from(table(spark, sf_dir, "customer"), "c_custkey", known, traces, "user_id", "ts").select("c_custkey", "available_at")
