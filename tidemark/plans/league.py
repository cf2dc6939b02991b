"""Lineups, schedules, odds, served lists over customers, events and parts."""

from pyspark.sql import functions as F

from tidemark.operators import league
from tidemark.plans.rates import SCORED, scored
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_ROSTER = "SELECT c_nationkey AS team, c_custkey AS player, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'B' ELSE 'C' END AS pos, CASE WHEN c_acctbal > 0 THEN c_acctbal + c_custkey / 1000.0 ELSE 0 END AS pts FROM customer"


def roster(spark, sf_dir):
    pos = F.when(F.col("c_mktsegment") == "BUILDING", "A").when(F.col("c_mktsegment") == "MACHINERY", "B").otherwise("C")
    pts = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + F.col("c_custkey") / 1000.0).otherwise(0.0)
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("player"), pos.alias("pos"), pts.alias("pts"))


_BEST = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY team, pos ORDER BY pts DESC, player) AS k FROM ({_ROSTER}) WHERE pts > 0), f AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pts DESC, player) AS i FROM r WHERE pos <> 'C' AND k > 1),
b AS (SELECT team, player, pts FROM r WHERE pos IN ('A', 'B') AND k = 1 UNION ALL SELECT team, player, pts FROM f WHERE i = 1)"""


@query(f"{_BEST} SELECT team, player FROM b")
def lineup_optimizer(spark, sf_dir):
    slots = {"A": ["A"], "B": ["B"], "FLEX": ["A", "B"]}
    return league.lineups(roster(spark, sf_dir), ["team"], "player", "pos", "pts", slots).select("team", "player")


@query(f"""{_BEST}, s AS (SELECT team, sum(CAST(pts AS DECIMAL(18,2))) AS a FROM ({_ROSTER}) WHERE player % 9 = 0 GROUP BY team), o AS (SELECT team, sum(CAST(pts AS DECIMAL(18,2))) AS o FROM b GROUP BY team)
SELECT team, CAST(a AS DOUBLE) AS actual, CAST(o AS DOUBLE) AS optimal, round(CAST(o AS DOUBLE) - CAST(a AS DOUBLE), 4) AS regret FROM s JOIN o USING (team)""")
def lineup_regret(spark, sf_dir):
    r = roster(spark, sf_dir)
    best = league.lineups(r, ["team"], "player", "pos", "pts", {"A": ["A"], "B": ["B"], "FLEX": ["A", "B"]}).join(r.select("player", "pts"), "player")
    return league.regret(r.where("player % 9 = 0"), best, ["team"], "player", "pts").withColumn("regret", F.round("regret", 4))


_WEEKS = "SELECT n_nationkey AS team, w, n_nationkey * 37 % 101 + w * n_nationkey % 13 AS pts, CASE WHEN (n_nationkey + w) % 2 = 0 THEN n_nationkey + 1 ELSE n_nationkey - 1 END AS raw FROM nation, (SELECT unnest(range(1, 9)) AS w) WHERE n_nationkey < 8"


def matchups(spark, sf_dir):
    n = F.col("n_nationkey")
    w = table(spark, sf_dir, "nation").where("n_nationkey < 8").withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(8))))
    raw = F.when((n + F.col("w")) % 2 == 0, n + 1).otherwise(n - 1)
    return w.select(n.alias("team"), "w", (n * 37 % 101 + F.col("w") * n % 13).alias("pts"), ((raw + 8) % 8).alias("opp"))


@query(f"""WITH s AS (SELECT team, w, pts, (raw + 8) % 8 AS opp FROM ({_WEEKS})), p AS (SELECT a.team, b.team AS other, a.w, a.pts, CASE WHEN b.opp = a.team THEN b.team ELSE b.opp END AS v FROM s a JOIN s b ON a.w = b.w)
SELECT p.team, other AS with_schedule_of, CAST(sum(CASE WHEN p.pts > s.pts THEN 1.0 WHEN p.pts = s.pts THEN 0.5 ELSE 0 END) AS DOUBLE) AS wins FROM p JOIN s ON s.team = p.v AND s.w = p.w GROUP BY ALL""")
def schedule_swap(spark, sf_dir):
    return league.swapped(matchups(spark, sf_dir), "team", "w", "pts", "opp")


_DRAW = "CAST(('0x' || substr(md5('5-' || sim || '-' || game || '-' || {side}), 1, 8)) AS BIGINT) % n"


@query(f"""WITH s AS (SELECT team, w, pts, (raw + 8) % 8 AS opp FROM ({_WEEKS})), l AS (SELECT avg(pts) AS m FROM s), m AS (SELECT team, count(*) AS games, (sum(pts) + 4.0 * any_value(m)) / (count(*) + 4.0) AS mean FROM s, l GROUP BY team),
r AS (SELECT row_number() OVER (ORDER BY team, w) - 1 AS i, pts - mean AS r FROM s JOIN m USING (team)), c AS (SELECT count(*) AS n FROM r), w AS (SELECT a.team, CAST(sum(CASE WHEN a.pts > b.pts THEN 1.0 WHEN a.pts = b.pts THEN 0.5 ELSE 0 END) AS DOUBLE) AS wins FROM s a JOIN s b ON b.team = a.opp AND b.w = a.w GROUP BY a.team),
g AS (SELECT a.team * 100 + b.team AS game, a.team AS a, b.team AS b FROM m a JOIN m b ON a.team < b.team), e AS (SELECT g.*, sim, {_DRAW.format(side="a")} AS ia, {_DRAW.format(side="b")} AS ib FROM g, c, (SELECT unnest(range(40)) AS sim)),
x AS (SELECT sim, a, b, ma.mean + ra.r AS x, mb.mean + rb.r AS y FROM e JOIN m ma ON ma.team = a JOIN m mb ON mb.team = b JOIN r ra ON ra.i = ia JOIN r rb ON rb.i = ib),
t AS (SELECT sim, team, sum(v) AS v FROM (SELECT sim, a AS team, CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0 END AS v FROM x UNION ALL SELECT sim, b, 1 - CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0 END FROM x) GROUP BY ALL),
p AS (SELECT t.team, v + wins AS v, row_number() OVER (PARTITION BY sim ORDER BY v + wins DESC, t.team) AS place FROM t JOIN w ON w.team = t.team) SELECT team, round(CAST(count(*) FILTER (WHERE place <= 3) AS DOUBLE) / 40, 9) AS odds, round(avg(v), 6) AS wins FROM p GROUP BY team""")
def playoff_odds(spark, sf_dir):
    from pyspark.sql import Window

    s = matchups(spark, sf_dir)
    m = league.shrunk_means(s, "team", "pts", 4)
    r = s.join(m, "team").select((F.row_number().over(Window.orderBy("team", "w")) - 1).cast("long").alias("i"), (F.col("pts") - F.col("mean")).alias("r"))
    held = s.select(F.col("team").alias("opp"), "w", F.col("pts").alias("y"))
    won = F.when(F.col("pts") > F.col("y"), 1.0).when(F.col("pts") == F.col("y"), 0.5).otherwise(0.0)
    wins = s.join(held, ["opp", "w"]).groupBy("team").agg(F.sum(won).alias("wins"))
    teams = s.select("team").distinct()
    g = teams.withColumnRenamed("team", "a").join(teams.withColumnRenamed("team", "b"), F.col("a") < F.col("b")).withColumn("game", F.col("a") * 100 + F.col("b"))
    return league.odds(m, r, g, wins, "team", 40, 3, 5).select("team", F.round("odds", 9).alias("odds"), F.round("wins", 6).alias("wins"))


@query("""SELECT flips, CAST(size AS INTEGER) AS size, error FROM (SELECT '' AS flips, 0 AS size, round(avg(abs(b - t)), 6) AS error FROM x UNION ALL SELECT 'tax', 1, round(avg(abs(b + f1 - t)), 6) FROM x UNION ALL SELECT 'late', 1, round(avg(abs(b + f2 - t)), 6) FROM x UNION ALL SELECT 'flag', 1, round(avg(abs(b + f3 - t)), 6) FROM x
UNION ALL SELECT 'tax,late', 2, round(avg(abs(b + f1 + f2 - t)), 6) FROM x UNION ALL SELECT 'tax,flag', 2, round(avg(abs(b + f1 + f3 - t)), 6) FROM x UNION ALL SELECT 'late,flag', 2, round(avg(abs(b + f2 + f3 - t)), 6) FROM x)""".replace(" FROM x", " FROM (SELECT l_quantity AS b, l_quantity + l_tax * 10 + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS t, l_tax * 10 AS f1, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS f2, CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 0.0 END AS f3 FROM lineitem)"))
def scoring_check(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "R", 2.0).otherwise(0.0)
    x = table(spark, sf_dir, "lineitem").withColumn("theirs", F.col("l_quantity") + F.col("l_tax") * 10 + flag)
    flips = {"tax": F.col("l_tax") * 10, "late": F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0), "flag": flag}
    return league.explained(x, "l_quantity", "theirs", flips, 2)


@query("""WITH p AS (SELECT p_partkey, p_brand, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')), m AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS place FROM p WHERE k <= 20) SELECT p_partkey, p_brand, score, CAST(place AS INTEGER) AS place FROM m WHERE place <= 25""")
def flex_merge_rerank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lists = [p.where(F.col("p_brand") == f"Brand#{k}").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey", "p_brand", F.col("p_retailprice").alias("score")) for k in (1, 2, 3)]
    return league.merged_flex(lists, "p_partkey", "score", 25)


@query("""WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, 2000 * l_linenumber AS low, 60000 - 2000 * l_linenumber AS high FROM lineitem) SELECT * FROM (SELECT g, count(*) AS n, round(avg(CAST(v BETWEEN low AND high AS INTEGER)), 9) AS inside, round(avg(CAST(v < low AS INTEGER)), 9) AS below, round(avg(CAST(v > high AS INTEGER)), 9) AS above FROM r GROUP BY g
UNION ALL SELECT 'All', count(*), round(avg(CAST(v BETWEEN low AND high AS INTEGER)), 9), round(avg(CAST(v < low AS INTEGER)), 9), round(avg(CAST(v > high AS INTEGER)), 9) FROM r)""")
def range_coverage(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"), (2000 * F.col("l_linenumber")).alias("low"), (60_000 - 2000 * F.col("l_linenumber")).alias("high"))
    return league.coverage(r, "g", "v", "low", "high")


@query("""SELECT e.event_id, e.user_id FROM events e WHERE CAST(e.ts AS DATE) = (SELECT max(CAST(x.ts AS DATE)) FROM events x WHERE x.user_id = e.user_id)""")
def latest_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return league.latest_snapshot(e, ["user_id"], "day").drop("day")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 10 > 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 3 > 0)
SELECT n.k, n.s, n.v, CASE WHEN o.k IS NULL THEN 'insert' ELSE 'update' END AS change FROM n LEFT JOIN o ON o.k = n.k WHERE o.k IS NULL OR o.s IS DISTINCT FROM n.s OR o.v IS DISTINCT FROM n.v""")
def upsert_when_changed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    fresh = o.where("k % 3 > 0").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))
    return league.changes(o.where("k % 10 > 0"), fresh, ["k"])


@query("""WITH n AS (SELECT p_brand, list(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS e, count(*) >= 5 AS full_list FROM part GROUP BY 1), o AS (SELECT p_brand, list(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS e FROM part WHERE p_brand <> 'Brand#3' AND (p_brand <> 'Brand#4' OR p_partkey % 5 > 0) GROUP BY 1)
SELECT n.p_brand, CASE WHEN NOT full_list THEN 'incomplete' WHEN o.e IS NULL THEN 'publish' WHEN o.e = n.e THEN 'skip' ELSE 'freeze' END AS action FROM n LEFT JOIN o USING (p_brand)""")
def live_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (-F.col("p_retailprice")).alias("order"))
    fresh = league.list_state(p, ["p_brand"], "p_partkey", "order").withColumn("whole", F.size("entities") >= 5)
    old = league.list_state(p.where("p_brand <> 'Brand#3' and (p_brand <> 'Brand#4' or p_partkey % 5 > 0)"), ["p_brand"], "p_partkey", "order")
    return league.live_plan(fresh, old, ["p_brand"], "whole")


@query(f"""SELECT CASE WHEN p < 0.1 THEN '0-10' WHEN p < 0.5 THEN '10-50' ELSE '50-100' END AS bin, count(*) AS n, CAST(sum(quality) AS BIGINT) AS hits, count(DISTINCT (lang, quality)) AS n_tuples, round(avg(p), 9) AS mean_p FROM ({SCORED}) GROUP BY 1""")
def binned_calibration(spark, sf_dir):
    p = F.col("p")
    bin_ = F.when(p < 0.1, "0-10").when(p < 0.5, "10-50").otherwise("50-100")
    return scored(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("hits"), F.count_distinct("lang", "quality").alias("n_tuples"), F.round(F.avg("p"), 9).alias("mean_p"))


@query("""WITH r AS (SELECT o_orderpriority AS list, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT list, count(*) FILTER (WHERE place <= 10) AS n10, count(user_id) FILTER (WHERE place <= 10) AS hits10, count(user_id) FILTER (WHERE place <= 50) AS hits50 FROM r LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') ON user_id = o_custkey WHERE place <= 50 GROUP BY list""")
def counts_by_rank(spark, sf_dir):
    from tidemark.functions import metrics

    r = metrics.ranked(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "list"), ["list"], "o_totalprice", "o_orderkey").where("place <= 50")
    hit = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id").distinct()
    x = r.join(hit, F.col("user_id") == F.col("o_custkey"), "left")
    return x.groupBy("list").agg(F.count_if(F.col("place") <= 10).alias("n10"), F.count(F.when(F.col("place") <= 10, F.col("user_id"))).alias("hits10"), F.count("user_id").alias("hits50"))


@query("""SELECT kind, id, v FROM (SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS v FROM orders UNION ALL SELECT 'event', event_id, value * 1000 FROM events) ORDER BY v DESC, kind, id LIMIT 30""")
def merged_top(spark, sf_dir):
    """The first rows of two tables as one list: each is cut before they meet."""
    one = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    two = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), (F.col("value") * 1000).alias("v"))
    order = [F.col("v").desc(), F.col("kind"), F.col("id")]
    return one.orderBy(*order).limit(30).unionAll(two.orderBy(*order).limit(30)).orderBy(*order).limit(30)


@query("""WITH x AS (SELECT p_brand AS g, p_type AS r, p_retailprice AS v FROM part), b AS (SELECT r, sum(v) / (SELECT sum(v) FROM x) AS p FROM x GROUP BY r), t AS (SELECT g, sum(v) AS t FROM x GROUP BY g), c AS (SELECT g, r, sum(v) AS s FROM x GROUP BY ALL), s AS (SELECT c.g, c.r, (s + 500.0 * p) / (t + 500.0) AS share FROM c JOIN t ON c.g = t.g JOIN b ON b.r = c.r)
SELECT k, g, r, round(least(amount * share, amount), 6) AS gain FROM (SELECT n_nationkey AS k, 'Brand#' || (n_nationkey % 20 + 1) AS g, n_nationkey * 10.0 AS amount FROM nation) e JOIN s USING (g)""")
def allocation_predict(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_type").alias("r"), F.col("p_retailprice").alias("v"))
    k = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(k.alias("k"), F.concat(F.lit("Brand#"), (k % 20 + 1).cast("string")).alias("g"), (k * 10.0).alias("amount"))
    out = league.allocated(e, league.allocation_cells(x, ["g"], "r", "v", 500), ["g"], "r", "amount")
    return out.select("k", "g", "r", F.round("gain", 6).alias("gain"))


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS team FROM customer), g AS (SELECT o_custkey % 25 AS team, CAST(month(o_orderdate) AS INTEGER) AS week, min(o_custkey) AS opponent FROM orders WHERE year(o_orderdate) = 1997 AND o_orderkey % 3 = 0 GROUP BY ALL) SELECT CAST(t.team AS BIGINT) AS team, w.week, opponent, opponent IS NULL AS bye FROM t CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS week) w LEFT JOIN g ON g.team = t.team AND g.week = w.week""")
def opponent_grid(spark, sf_dir):
    from tidemark.operators import joins

    g = table(spark, sf_dir, "orders").where("year(o_orderdate) = 1997 and o_orderkey % 3 = 0").groupBy((F.col("o_custkey") % 25).alias("team"), F.month("o_orderdate").alias("week")).agg(F.min("o_custkey").alias("opponent"))
    teams = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("team")).distinct()
    weeks = spark.range(1, 13).select(F.col("id").cast("int").alias("week"))
    return joins.complete(g, [teams, weeks], {}).withColumn("bye", F.col("opponent").isNull()).select("team", "week", "opponent", "bye")

