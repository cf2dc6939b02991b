"""Pools, finishes, labels, absences, opponents: customers as players, nations as teams, months as weeks."""

from pyspark.sql import functions as F

from tidemark.functions.exprs import exact_sum
from tidemark.operators import pool
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_SCORES = "SELECT o_custkey AS player, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS week, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS score FROM orders GROUP BY ALL"
_NATIONS = "SELECT c_custkey AS player, c_nationkey AS team, c_mktsegment AS pos FROM customer"


def scores(spark, sf_dir):
    week = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("week")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player"), week).agg(exact_sum("o_totalprice").alias("score"))


def players(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player"), F.col("c_nationkey").alias("team"), F.col("c_mktsegment").alias("pos"))


@query("""WITH r AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT user_id, coalesce(excluded_by, 'in pool') AS state, excluded_by IS NULL AS in_pool FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'status' WHEN value > 300 THEN 'owned' WHEN user_id % 7 = 0 THEN 'rostered' END AS excluded_by FROM r WHERE rn = 1)""")
def candidate_pool(spark, sf_dir):
    seen = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    base = pool.latest(seen, ["user_id"], [F.col("ts").desc(), F.col("event_id")])
    rules = [("status", F.col("event_type") == "error"), ("owned", F.col("value") > 300), ("rostered", F.col("user_id") % 7 == 0)]
    return pool.membership(base, rules).select("user_id", F.coalesce("excluded_by", F.lit("in pool")).alias("state"), "in_pool")


@query("""SELECT CAST(day(ts) // 8 AS INTEGER) AS season, bool_or(n > 1) AS weekly FROM (SELECT user_id, ts, count(DISTINCT event_type) OVER (PARTITION BY user_id, day(ts) // 8) AS n FROM events) GROUP BY 1""")
def status_is_weekly(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("season", F.expr("day(ts) div 8").cast("int"))
    return pool.weekly(e, ["user_id"], "season", "event_type")


@query(f"""SELECT player, week, finish, "of", finish <= 3 AS top3, finish <= 10 AS top10 FROM (SELECT s.player, week, rank() OVER (PARTITION BY week, pos ORDER BY score DESC) AS finish, count(*) OVER (PARTITION BY week, pos) AS "of" FROM ({_SCORES}) s JOIN ({_NATIONS}) n ON s.player = n.player)""")
def weekly_finishes(spark, sf_dir):
    s = scores(spark, sf_dir).join(players(spark, sf_dir), "player")
    return pool.finishes(s, ["week"], "pos", "score", {"top3": 3, "top10": 10}).select("player", "week", "finish", "of", "top3", "top10")


@query(f"""WITH p AS (SELECT o_custkey AS player, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS week, max(o_orderstatus) AS pos FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT s.player, s.week, coalesce(p.pos, 'none') AS pos FROM ({_SCORES}) s ASOF LEFT JOIN p ON s.player = p.player AND s.week >= p.week""")
def position_fallback(spark, sf_dir):
    week = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("week")
    known = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("player"), week).agg(F.max("o_orderstatus").alias("pos"))
    return pool.position_at(scores(spark, sf_dir).drop("score"), known, "player", "week", "pos", F.lit("none"))


_SLOTS = f"""WITH s AS ({_SCORES}), k AS (SELECT player, week FROM s), x AS (SELECT k.player, k.week, g.week AS nxt, g.score, row_number() OVER (PARTITION BY k.player, k.week ORDER BY g.week) AS i FROM k JOIN s g ON g.player = k.player AND g.week > k.week)"""


@query(f"""{_SLOTS} SELECT player, week, count(*) AS n_slots, count(*) FILTER (WHERE nxt <= 24020 AND score > 200000) AS n_hits, count(*) FILTER (WHERE nxt <= 24020 AND score <= 200000) AS n_misses,
 CASE WHEN count(*) FILTER (WHERE nxt <= 24020 AND score > 200000) >= 2 THEN true WHEN count(*) - count(*) FILTER (WHERE nxt <= 24020 AND score <= 200000) < 2 THEN false END AS label FROM x WHERE i <= 3 GROUP BY player, week""")
def slot_labels(spark, sf_dir):
    """Two hits of the next three games; null while it is open."""
    s = scores(spark, sf_dir)
    ahead = pool.upcoming(s.select("player", "week"), s, "player", "week", 3)
    slots = ahead.select("player", "week", F.explode("slots").alias("g")).select("player", "week", F.col("g.week").alias("at"), (F.col("g.score") > 200_000).alias("hit"))
    return pool.hits(slots, ["player", "week"], 3, 2, "at", F.lit(24020))


@query(f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY week DESC) AS k FROM ({_SCORES}))
SELECT player, round(max(score) FILTER (WHERE k = 1), 6) AS last, round(avg(score) FILTER (WHERE k <= 3), 6) AS recent, round(avg(score), 6) AS season, round(avg(score) FILTER (WHERE k <= 3) - avg(score), 6) AS delta FROM g GROUP BY player""")
def opportunity_windows(spark, sf_dir):
    g = pool.form(pool.recency(scores(spark, sf_dir), "player", ["week"]), ["player"], "score", 3)
    return g.select("player", F.round("last", 6).alias("last"), F.round("recent", 6).alias("recent"), F.round("season", 6).alias("season"), F.round("delta", 6).alias("delta"))


@query("""WITH v AS (SELECT c_custkey, c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100)
SELECT c_nationkey, round(sum(CASE WHEN user_id IS NOT NULL THEN value ELSE 0 END) / sum(value), 9) AS share, count(user_id) AS n_out, arg_max(c_custkey, (value, c_custkey)) FILTER (WHERE user_id IS NOT NULL) AS largest FROM v LEFT JOIN a ON user_id = c_custkey GROUP BY c_nationkey""")
def teammate_absences(spark, sf_dir):
    v = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_nationkey").agg(exact_sum("o_totalprice").alias("value"))
    absent = table(spark, sf_dir, "events").where("event_type = 'error' and value > 100").select(F.col("user_id").alias("c_custkey"))
    return pool.vacated(v, absent, "c_custkey", "c_nationkey", "value").withColumn("share", F.round("share", 9))


@query("""WITH g AS (SELECT l_suppkey AS opponent, p_brand AS grp, l_extendedprice AS points FROM lineitem JOIN part ON l_partkey = p_partkey), a AS (SELECT opponent, grp, avg(points) AS allowed, count(*) AS n FROM g GROUP BY ALL)
SELECT s_suppkey AS opponent, m.grp, coalesce(n, 0) AS n, round(coalesce(allowed / league, 1.0), 6) AS ratio FROM supplier CROSS JOIN (SELECT grp, avg(points) AS league FROM g GROUP BY grp) m LEFT JOIN a ON a.opponent = s_suppkey AND a.grp = m.grp""")
def opponent_strength(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = g.select(F.col("l_suppkey").alias("opponent"), F.col("p_brand").alias("grp"), F.col("l_extendedprice").alias("points"))
    opponents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("opponent"))
    return pool.strength(g, "opponent", "grp", "points", opponents).withColumn("ratio", F.round("ratio", 6))


@query(f"""{_SLOTS} SELECT player, week, round(avg(CASE WHEN nxt % 5 > 0 THEN score / 150000 ELSE 1 END), 9) AS mean_ratio, count(*) AS n_games, count(DISTINCT nxt) < 4 AS bye FROM x WHERE i <= 4 GROUP BY player, week""")
def schedule_features(spark, sf_dir):
    s = scores(spark, sf_dir)
    ahead = pool.upcoming(s.select("player", "week"), s, "player", "week", 4).select("player", F.col("week").alias("from_week"), F.explode("slots").alias("g"))
    slots = ahead.select("player", "from_week", F.col("g.week").alias("week"), F.when(F.col("g.week") % 5 > 0, F.col("g.score") / 150_000).alias("ratio"))
    out = pool.schedule(slots, ["player", "from_week"], "ratio", 4)
    return out.select("player", F.col("from_week").alias("week"), F.round("mean_ratio", 9).alias("mean_ratio"), "n_games", "bye")


@query(f"""WITH h AS (SELECT player, week // 12 AS season, week, score > 100000 AS hit FROM ({_SCORES})), r AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER w AS s, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT player, CAST(season AS INTEGER) AS season, min(week) AS breakout FROM r WHERE s = 3 AND n = 3 GROUP BY ALL""")
def breakout_events(spark, sf_dir):
    h = scores(spark, sf_dir).select("player", F.expr("week div 12").cast("int").alias("season"), "week", (F.col("score") > 100_000).alias("hit"))
    return pool.breakouts(h, "player", "season", "week", "hit", 3)


@query("""WITH p AS (SELECT event_type AS grp, user_id, CAST(ts AS DATE) AS day, CAST(floor(value) AS INTEGER) AS place FROM events), a AS (SELECT *, CAST(max(day) OVER (PARTITION BY grp) - day AS INTEGER) AS age FROM p)
SELECT grp, user_id, place, age FROM (SELECT *, row_number() OVER (PARTITION BY grp, user_id ORDER BY day DESC, place) AS rn FROM a WHERE age <= 6) WHERE rn = 1""")
def expert_ranks(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "user_id", F.to_date("ts").alias("day"), F.floor("value").cast("int").alias("place"))
    return pool.ranks_with_age(p, "user_id", "grp", "day", "place", 6)
