"""Seasons, tenures, hazards, boards and signals over customers, orders and events."""

from pyspark.sql import functions as F

from tidemark.functions.exprs import exact_sum
from tidemark.operators import careers
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_YEARS = "SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) AS n, max(o_orderstatus) AS s FROM orders GROUP BY ALL"


def years(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(exact_sum("o_totalprice").alias("v"), F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))


@query("""WITH m AS (SELECT s_suppkey, CAST(round(s_acctbal / 10 - 400) AS INTEGER) AS h, CAST(round(350 - s_acctbal / 12) AS INTEGER) AS a FROM supplier), i AS (SELECT s_suppkey, CASE WHEN h < 0 THEN -h / CAST(-h + 100 AS DOUBLE) WHEN h > 0 THEN 100.0 / (h + 100) END AS h, CASE WHEN a < 0 THEN -a / CAST(-a + 100 AS DOUBLE) WHEN a > 0 THEN 100.0 / (a + 100) END AS a FROM m)
SELECT s_suppkey, round(h / (h + a), 9) AS p FROM i""")
def moneyline_prob(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 10 - 400).cast("int").alias("h"), F.round(350 - F.col("s_acctbal") / 12).cast("int").alias("a"))
    return s.select("s_suppkey", F.round(careers.moneyline_prob(F.col("h"), F.col("a")), 9).alias("p"))


@query("""WITH RECURSIVE s AS (SELECT (o_custkey % 29 - 14) * 1.0 AS x, CASE WHEN (o_custkey % 29 - 14) + o_orderkey % 31 - 15 > 0 THEN 1 ELSE 0 END AS y FROM orders),
n(k, b) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT k + 1, b + g / h FROM (SELECT k, b, sum((y - f) * x) AS g, sum(f * (1 - f) * x * x) AS h FROM (SELECT k, b, x, y, 1 / (1 + exp(-b * x)) AS f FROM n, s WHERE k < 8) GROUP BY k, b)) SELECT round(b, 6) AS slope FROM n WHERE k = 8""")
def spread_slope(spark, sf_dir):
    x = (F.col("o_custkey") % 29 - 14).cast("double")
    rows = table(spark, sf_dir, "orders").select(x.alias("x"), (x + F.col("o_orderkey") % 31 - 15 > 0).cast("int").alias("y"))
    return spark.createDataFrame([(round(careers.slope(rows, "x", "y", 8), 6),)], "slope double")


_GAMES = "SELECT s_nationkey AS home, p_size % 25 AS away, CAST(year(l_shipdate) AS INTEGER) AS season, CAST(l_quantity AS INTEGER) AS hs, CAST(floor(l_extendedprice) AS INTEGER) % 50 AS a_s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"


def team_rows(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = g.select(F.col("s_nationkey").alias("home"), (F.col("p_size") % 25).alias("away"), F.year("l_shipdate").alias("season"), F.col("l_quantity").cast("int").alias("hs"), (F.floor("l_extendedprice").cast("int") % 50).alias("a_s"))
    return careers.sides(g, {"team": "home", "scored": "hs", "allowed": "a_s"}, {"team": "away", "scored": "a_s", "allowed": "hs"}, ["season"])


_SIDES = f"WITH g AS ({_GAMES}), t AS (SELECT season, home AS team, hs AS scored, a_s AS allowed FROM g UNION ALL SELECT season, away, a_s, hs FROM g), r AS (SELECT team, season, CAST(sum(CASE WHEN scored > allowed THEN 1.0 WHEN scored = allowed THEN 0.5 ELSE 0 END) AS DOUBLE) AS wins, count(*) AS games, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(allowed) AS BIGINT) AS allowed FROM t GROUP BY ALL)"


@query(f"{_SIDES} SELECT team, season, wins, games, round(wins / games, 9) AS share, round(pow(scored, 2.37) / (pow(scored, 2.37) + pow(allowed, 2.37)), 9) AS pythagorean, CAST(rank() OVER (PARTITION BY season, team % 5 ORDER BY wins / games DESC) AS INTEGER) AS division_rank FROM r")
def season_records(spark, sf_dir):
    from pyspark.sql import Window

    r = careers.records(team_rows(spark, sf_dir), "team", "season", "scored", "allowed")
    rank = F.rank().over(Window.partitionBy("season", F.col("team") % 5).orderBy(F.col("share").desc()))
    return r.select("team", "season", "wins", "games", F.round("share", 9).alias("share"), F.round(careers.pythagorean(F.col("scored"), F.col("allowed")), 9).alias("pythagorean"), rank.alias("division_rank"))


@query(f"""{_SIDES}, c AS (SELECT team, season, CAST(season * team % 7 < 4 AS INTEGER) AS coach, wins / games AS share FROM r WHERE (team + season) % 11 > 0),
i AS (SELECT *, CASE WHEN lag(season) OVER w = season - 1 AND lag(coach) OVER w = coach THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY team ORDER BY season)), j AS (SELECT *, sum(s) OVER (PARTITION BY team ORDER BY season) AS island FROM i),
k AS (SELECT *, row_number() OVER v AS years, min(season) OVER (PARTITION BY team, island) AS start, max(CASE WHEN share >= 0.5 THEN season END) OVER (PARTITION BY team, island ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS won FROM j WINDOW v AS (PARTITION BY team, island ORDER BY season))
SELECT team, season, years, CAST(season - coalesce(won, start - 1) - 1 AS BIGINT) AS losing, years = 1 AS took_over, start = 1995 AS censored FROM k""")
def coach_context(spark, sf_dir):
    r = careers.records(team_rows(spark, sf_dir), "team", "season", "scored", "allowed").where((F.col("team") + F.col("season")) % 11 > 0)
    c = r.select("team", "season", (F.col("season") * F.col("team") % 7 < 4).cast("int").alias("coach"), "share")
    return careers.tenure(c, "team", "season", "coach", "share", 1995).select("team", "season", "years", "losing", "took_over", "censored")


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS s, count(value) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM g)
SELECT user_id, round(sum(s) / sum(n), 6) AS season, round(sum(s) FILTER (WHERE k <= 4) / sum(n) FILTER (WHERE k <= 4), 6) AS late FROM k GROUP BY user_id""")
def neutral_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("day", F.to_date("ts"))
    return careers.trend(e, "user_id", ["day"], "value", 4).select("user_id", F.round("season", 6).alias("season"), F.round("late", 6).alias("late"))


@query("""WITH p AS (SELECT o_custkey AS team, count(*) AS played FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), c AS (SELECT o_custkey AS team, count(*) AS off FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0 GROUP BY 1)
SELECT p.team, played, (SELECT max(played) FROM p) - played - coalesce(off, 0) AS remaining FROM p LEFT JOIN c USING (team)""")
def games_remaining(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "team")
    return careers.remaining(o.where("o_orderstatus <> 'P'"), "team", o.where("o_orderstatus = 'P' and o_orderkey % 4 = 0"))


@query("""WITH x AS (SELECT c_custkey, c_nationkey % 9 AS g FROM customer), e AS (SELECT c_custkey, unnest(range(0, g + 1)) AS k FROM x) SELECT c_custkey, round(1 - exp(sum(ln(1 - 1 / (1 + exp(3 - 0.1 * k))))), 9) AS risk, count(*) AS intervals FROM e GROUP BY c_custkey""")
def season_risk(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 9).alias("g"))
    out = careers.season_risk(x, "c_custkey", "g", lambda k: 1 / (1 + F.exp(3 - 0.1 * k)))
    return out.select("c_custkey", F.round("risk", 9).alias("risk"), "intervals")


@query("""WITH r AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS opened FROM events), f AS (SELECT user_id, min(day) AS day, arg_min(kind, day) AS kind FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(event_type) AS kind FROM events WHERE value > 200 AND event_type IN ('error', 'purchase') GROUP BY ALL) GROUP BY 1)
SELECT r.user_id, opened, CASE WHEN coalesce(day > opened AND day <= opened + 7, false) THEN CASE WHEN kind = 'purchase' THEN true END ELSE false END AS label FROM r LEFT JOIN f ON r.user_id = f.user_id WHERE day IS NULL OR opened < day""")
def hazard_targets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("opened")).distinct().withColumn("ends", F.date_add("opened", 7))
    found = e.where("value > 200 and event_type in ('error', 'purchase')").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_type").alias("kind"))
    return careers.hazard_targets(rows, found, "user_id", "opened", "ends", ["purchase"]).drop("ends")


@query(f"SELECT k, y, CASE WHEN n >= 2 THEN CAST(rank() OVER (PARTITION BY y, s, n >= 2 ORDER BY v DESC) AS INTEGER) END AS place FROM ({_YEARS})")
def rank_in_season(spark, sf_dir):
    return careers.season_ranks(years(spark, sf_dir), "y", "s", "v", "n", 2).select("k", "y", "place")


@query(f"""WITH x AS (SELECT s, CAST(y - 1995 AS DOUBLE) AS x, v / 100000 AS t FROM ({_YEARS})), q AS (SELECT s, sum(1.0) s0, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(t) t0, sum(x*t) t1, sum(x*x*t) t2 FROM x GROUP BY s), d AS (SELECT *, s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2) AS det FROM q)
SELECT s, round((t0*(s2*s4-s3*s3)-s1*(t1*s4-t2*s3)+s2*(t1*s3-t2*s2))/det, 5) AS a, round((s0*(t1*s4-t2*s3)-t0*(s1*s4-s2*s3)+s2*(s1*t2-s2*t1))/det, 5) AS b, round((s0*(s2*t2-s3*t1)-s1*(s1*t2-s2*t1)+t0*(s1*s3-s2*s2))/det, 5) AS c FROM d""")
def aging_curves(spark, sf_dir):
    x = years(spark, sf_dir).select("s", (F.col("y") - 1995).alias("x"), (F.col("v") / 100_000).alias("t"))
    return careers.quadratic(x, "s", "x", "t").select("s", *[F.round(c, 5).alias(c) for c in ("a", "b", "c")])


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS t FROM part)
SELECT p_partkey, CAST(t - m AS INTEGER) AS gap, CASE WHEN m <= 10 AND t <= 10 THEN 'both' WHEN m <= 10 THEN 'model_only' WHEN t <= 10 THEN 'other_only' END AS member FROM p""")
def ranking_disagreements(spark, sf_dir):
    return careers.disagreements(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice", "p_size", 10).select("p_partkey", "gap", "member")


@query("""SELECT event_id, count(*) OVER w AS n_before, CAST(coalesce(sum(CAST(value > 250 AS INTEGER)) OVER w, 0) AS BIGINT) AS events_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def tagged_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("large", F.col("value") > 250)
    return careers.prior_counts(e, "user_id", ["ts", "event_id"], "large").select("event_id", "n_before", "events_before")


_NESTED = """WITH x AS (SELECT c_mktsegment AS a, c_nationkey AS b, CAST(c_acctbal > 5000 AS INTEGER) AS y FROM customer), w AS (SELECT avg(y) AS r, count(*) AS n FROM x), l1 AS (SELECT a, count(*) AS n, (sum(y) + 25.0 * any_value(r)) / (count(*) + 25.0) AS rate FROM x, (SELECT r FROM w) GROUP BY a),
l2 AS (SELECT x.a, b, count(*) AS n, (sum(y) + 25.0 * any_value(rate)) / (count(*) + 25.0) AS rate FROM x JOIN l1 ON x.a = l1.a GROUP BY x.a, b)"""


@query(f"{_NESTED} SELECT CAST(0 AS INTEGER) AS depth, NULL AS a, NULL AS b, n, round(r, 9) AS rate FROM w UNION ALL SELECT 1, a, NULL, n, round(rate, 9) FROM l1 UNION ALL SELECT 2, a, b, n, round(rate, 9) FROM l2")
def hierarchical_cells(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    return careers.nested_rates(x, ["a", "b"], "y", 25).withColumn("rate", F.round("rate", 9))


@query(f"{_NESTED} SELECT c_custkey, round(coalesce(l2.rate, l1.rate, r), 9) AS rate FROM customer CROSS JOIN (SELECT r FROM w) LEFT JOIN l1 ON l1.a = c_mktsegment LEFT JOIN l2 ON l2.a = c_mktsegment AND l2.b = (c_nationkey + 1) AND c_custkey % 2 = 0")
def deepest_cell_predict(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x = c.select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    ask = c.select("c_custkey", F.col("c_mktsegment").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") + 1).alias("b"))
    return careers.predict_nested(ask, careers.nested_rates(x, ["a", "b"], "y", 25), ["a", "b"]).select("c_custkey", F.round("rate", 9).alias("rate"))


@query("""WITH b AS (SELECT user_id, arg_max(value, ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-08') AS baseline, min(ts) FILTER (WHERE ts > TIMESTAMP '2024-01-08' AND value >= 300) AS crossed FROM events GROUP BY 1) SELECT user_id, crossed FROM b WHERE coalesce(baseline < 300, true) AND crossed IS NOT NULL""")
def crowd_adds(spark, sf_dir):
    return careers.crossings(table(spark, sf_dir, "events"), "user_id", "ts", "value", 300, "2024-01-08 00:00:00").select("user_id", "crossed")


_WEEKLY = "SELECT user_id, CAST(week(ts) AS INTEGER) AS w, max(value) AS v FROM events GROUP BY ALL"


@query(f"""WITH v AS ({_WEEKLY}), m AS (SELECT user_id, min(w) AS flagged FROM (SELECT *, lag(w) OVER x AS pw, lag(v) OVER x AS pv FROM v WINDOW x AS (PARTITION BY user_id ORDER BY w)) WHERE pw = w - 1 AND v - pv >= 20 GROUP BY 1), a AS (SELECT user_id, min(w) AS added FROM v WHERE v >= 200 GROUP BY 1)
SELECT user_id, flagged, added, added - flagged AS lead, CASE WHEN added IS NULL THEN 'never added' WHEN flagged IS NULL THEN 'never flagged' WHEN added > flagged THEN 'early' WHEN added = flagged THEN 'same' ELSE 'late' END AS category FROM m FULL JOIN a USING (user_id)""")
def momentum_leads(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id", F.weekofyear("ts").alias("w")).agg(F.max("value").alias("v"))
    adds = v.where("v >= 200").groupBy("user_id").agg(F.min("w").alias("added"))
    return careers.leads(careers.momentum(v, "user_id", "w", "v", 20), adds, "user_id", "flagged", "added")


@query("""SELECT user_id, count(*) AS n, round(avg(gap), 6) AS gap FROM (SELECT user_id, lead(value) OVER w - value AS gap, event_type <> 'error' AND lead(event_type) OVER w <> 'error' AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ok GROUP BY user_id""")
def pace_pairs(spark, sf_dir):
    p = careers.pairs_in_order(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("event_type") != "error")
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("gap"))


@query(f"""WITH y AS ({_YEARS}), p AS (SELECT a.s, a.v, b.v AS f FROM y a JOIN y b ON a.k = b.k AND b.y = a.y + 1) SELECT s, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(v, f) END, 6) AS r FROM p GROUP BY s""")
def persistence_pairs(spark, sf_dir):
    from tidemark.functions import resample

    y = years(spark, sf_dir)
    p = careers.persistence(y, "k", "y", "v").join(y.select("k", "y", "s"), ["k", "y"])
    return p.groupBy("s").agg(F.count("*").alias("n"), F.round(resample.pearson("v", "following"), 6).alias("r"))
