"""Filters with account, cells, expectations, options and scores over lines, orders and events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import plays
from tidemark.plans.registry import query
from tidemark.sources.tables import table

RULES = {"l_quantity": 0.1, "l_discount": -20, "l_tax": 6}


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 0.1 + l_discount * -20.0 + l_tax * 6.0 AS points, l_quantity * 0.1 AS points_l_quantity, l_discount * -20.0 AS points_l_discount, l_tax * 6.0 AS points_l_tax FROM lineitem""")
def score_breakdown(spark, sf_dir):
    scored_lines = scoring.score(table(spark, sf_dir, "lineitem"), RULES, breakdown=True)
    return scored_lines.select("l_orderkey", "l_linenumber", "points", *[f"points_{c}" for c in RULES])


@query("""SELECT l_suppkey, round(sum(l_quantity * 0.1 + l_discount * -20.0 + l_tax * 6.0), 6) AS points, round(sum((l_quantity - 1) * 0.1 + (l_discount / 2) * -20.0 + (l_tax * 2) * 6.0), 6) AS xfp FROM lineitem GROUP BY l_suppkey""")
def score_from_sql(spark, sf_dir):
    """Points and expected points by the rules' SQL text."""
    x = table(spark, sf_dir, "lineitem").withColumns({"l_quantity_exp": F.col("l_quantity") - 1, "l_discount_exp": F.col("l_discount") / 2, "l_tax_exp": F.col("l_tax") * 2})
    return x.groupBy("l_suppkey").agg(F.round(F.sum(F.expr(scoring.score_sql(RULES))), 6).alias("points"), F.round(F.sum(F.expr(scoring.expected_sql(RULES))), 6).alias("xfp"))


@query("""WITH k AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity < 20 AND l_returnflag <> 'R') AS a, count(*) FILTER (WHERE l_quantity >= 20 AND l_quantity < 40 AND l_returnflag <> 'R') AS b, count(*) FILTER (WHERE l_quantity >= 40 AND l_returnflag <> 'R') AS c,
 count(*) FILTER (WHERE l_quantity < 20 AND l_returnflag = 'R') AS x, count(*) FILTER (WHERE l_quantity >= 20 AND l_returnflag = 'R') AS y, count(*) FILTER (WHERE l_linestatus = 'F') AS e, count(*) FILTER (WHERE l_linestatus = 'O') AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(a * 3.0 + b * 4.0 + c * 5.0 + x * -2.0 + y * -1.0 + e * 1.0 + m * -1.0 AS DOUBLE) AS points FROM k""")
def kicking_score(spark, sf_dir):
    q, missed = F.col("l_quantity"), F.col("l_returnflag") == "R"
    n = lambda c, name: F.count_if(c).alias(name)
    k = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        n((q < 20) & ~missed, "made_short"), n((q >= 20) & (q < 40) & ~missed, "made_mid"), n((q >= 40) & ~missed, "made_long"), n((q < 20) & missed, "missed_short"), n((q >= 20) & missed, "missed_far"),
        n(F.col("l_linestatus") == "F", "made_xp"), n(F.col("l_linestatus") == "O", "missed_xp"),
    )
    return scoring.score_kicking(k, {"short": 3, "mid": 4, "long": 5}, {"short": -2, "far": -1}, 1, -1).select("l_suppkey", "points")


@query("""SELECT o_orderkey, CAST(o_custkey % 5 * 2.0 + o_orderkey % 3 * 1.5 AS DOUBLE) + CASE WHEN t <= 100000 THEN 10 WHEN t <= 250000 THEN 4 ELSE -4 END + CASE WHEN y IS NULL THEN 0 WHEN y <= 10 THEN 5 WHEN y <= 20 THEN 2 ELSE -1 END AS points
FROM (SELECT *, o_totalprice AS t, CASE WHEN o_orderstatus <> 'P' THEN day(o_orderdate) END AS y FROM orders)""")
def defense_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("sacks"), (F.col("o_orderkey") % 3).alias("takeaways"), F.col("o_totalprice").alias("points_allowed"), F.when(F.col("o_orderstatus") != "P", F.day("o_orderdate")).alias("yards_allowed"))
    return scoring.score_defense(o, {"sacks": 2, "takeaways": 1.5}, [(100_000, 10), (250_000, 4), (None, -4)], [(10, 5), (20, 2), (None, -1)]).select("o_orderkey", "points")


@query("""SELECT event_id, coalesce((wp < 0.05 OR wp > 0.95) AND NOT coalesce(s <= 300 AND abs(m) <= 8, false), false) AS garbage_time, coalesce(wp BETWEEN 0.2 AND 0.8 AND h > 120, false) AS neutral
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 500 END AS wp, event_id % 3600 AS s, event_id % 1800 AS h, user_id % 30 - 15 AS m FROM events)""")
def play_situations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", F.when(F.col("event_type") != "error", F.col("value") / 500).alias("wp"), (F.col("event_id") % 3600).alias("seconds_left"), (F.col("event_id") % 1800).alias("half_seconds_left"), (F.col("user_id") % 30 - 15).alias("margin"))
    return scoring.flagged(p).select("event_id", "garbage_time", "neutral")


@query("""WITH x AS (SELECT CASE WHEN coalesce(NOT l_quantity > 5, true) THEN 0 WHEN l_returnflag = 'N' THEN 1 WHEN NOT l_tax < 0.07 THEN 2 ELSE 3 END AS s FROM lineitem)
SELECT CAST(step AS INTEGER) AS step, name, count(*) FILTER (WHERE s = step) AS dropped, count(*) FILTER (WHERE s > step) AS remaining FROM x, (VALUES (0, 'small'), (1, 'new'), (2, 'taxed')) n(step, name) GROUP BY ALL""")
def filter_accounting(spark, sf_dir):
    steps = [("small", F.col("l_quantity") > 5), ("new", F.col("l_returnflag") != "N"), ("taxed", F.col("l_tax") < 0.07)]
    return plays.filtered(table(spark, sf_dir, "lineitem"), steps)[1]


@query("""SELECT coalesce(rule, 'none') AS rule, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderstatus = 'P' THEN 'open' WHEN month(o_orderdate) = 2 THEN 'february' END AS rule FROM orders) GROUP BY 1""")
def first_failing_rule(spark, sf_dir):
    rule = plays.first_rule([("large", F.col("o_totalprice") > 400_000), ("open", F.col("o_orderstatus") == "P"), ("february", F.month("o_orderdate") == 2)])
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(rule, F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, first_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_id END IGNORE NULLS) OVER w AS next_id, first_value(CASE WHEN event_type IN ('click', 'purchase') THEN value END IGNORE NULLS) OVER w AS next_value FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def next_snap(spark, sf_dir):
    valid = F.col("event_type").isin("click", "purchase")
    return plays.next_snap(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], valid, {"event_id": "next_id", "value": "next_value"}).select("event_id", "next_id", "next_value")


@query("""WITH k AS (SELECT o_orderpriority AS grp, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week, o_totalprice AS v FROM orders), w AS (SELECT DISTINCT grp, season, week FROM k)
SELECT w.grp, w.season, w.week, round(CASE WHEN n >= 30 THEN m ELSE pm END, 1) AS mean, round(CASE WHEN n >= 30 THEN md ELSE pmd END, 3) AS median FROM
(SELECT w.grp, w.season, w.week, count(k.v) AS n, avg(k.v) AS m, median(k.v) AS md FROM w LEFT JOIN k ON k.grp = w.grp AND k.season = w.season AND k.week < w.week GROUP BY ALL) w
LEFT JOIN (SELECT grp, season + 1 AS season, avg(v) AS pm, median(v) AS pmd FROM k GROUP BY ALL) p ON p.grp = w.grp AND p.season = w.season""")
def kickoff_spots(spark, sf_dir):
    """Season-to-date mean and median of strictly earlier weeks, last season's until there are enough."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_totalprice").alias("v"))
    x = plays.expanding_median(o, ["grp"], "season", "week", "v", 30)
    return x.select("grp", "season", "week", F.round("mean", 1).alias("mean"), F.round("median", 3).alias("median"))


_CELLS = """WITH c AS (SELECT o_orderpriority AS a, CAST(year(o_orderdate) AS INTEGER) AS b, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL),
l2 AS (SELECT a, b, s, n / sum(n) OVER (PARTITION BY a, b) AS p, sum(n) OVER (PARTITION BY a, b) AS t FROM c), l1 AS (SELECT a, s, sum(n) / sum(sum(n)) OVER (PARTITION BY a) AS p FROM c GROUP BY a, s),
l0 AS (SELECT s, sum(n) / sum(sum(n)) OVER () AS p FROM c GROUP BY s)"""


@query(f"{_CELLS} SELECT CAST(2 AS INTEGER) AS level, a, b, s, round(p, 9) AS p FROM l2 WHERE t >= 40 UNION ALL SELECT 1, a, NULL, s, round(p, 9) FROM l1 UNION ALL SELECT 0, NULL, NULL, s, round(p, 9) FROM l0")
def conversion_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("a"), F.year("o_orderdate").alias("b"), F.col("o_orderstatus").alias("s"))
    return plays.cells(o, ["a", "b"], "s", 40).withColumn("p", F.round("p", 9))


@query(f"""{_CELLS}, v AS (SELECT 2 AS level, a, b, sum(p * CASE s WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.4 ELSE 0.1 END) AS e FROM l2 WHERE t >= 40 GROUP BY a, b UNION ALL SELECT 1, a, NULL, sum(p * CASE s WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.4 ELSE 0.1 END) FROM l1 GROUP BY a)
SELECT o_orderkey, CAST(coalesce(x.level, y.level) AS INTEGER) AS level, round(coalesce(x.e, y.e), 6) AS expected FROM orders LEFT JOIN v x ON x.level = 2 AND x.a = o_orderpriority AND x.b = year(o_orderdate) LEFT JOIN v y ON y.level = 1 AND y.a = o_orderpriority""")
def cell_fallback_expectation(spark, sf_dir):
    """Each row meets its deepest cell that has enough rows, and the expectation over that cell's outcomes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"), F.year("o_orderdate").alias("b"), F.col("o_orderstatus").alias("s"))
    met = plays.with_distribution(o.drop("s"), plays.cells(o, ["a", "b"], "s", 40), ["a", "b"], "s")
    worth = lambda s: F.when(s == "F", 1.0).when(s == "O", 0.4).otherwise(0.1)
    return met.select("o_orderkey", "level", F.round(plays.expectation(F.col("outcomes"), worth), 6).alias("expected"))


@query("""WITH c AS (SELECT CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT a.q, c.f, sum(c.n * exp(-pow((a.q - c.q) / 2.5, 2) / 2)) AS m FROM (SELECT DISTINCT q FROM c) a JOIN c ON abs(a.q - c.q) <= 8 GROUP BY ALL)
SELECT q, f, round(m / sum(m) OVER (PARTITION BY q), 9) AS p FROM m""")
def punt_distribution(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"))
    return plays.kernel_table(x, "q", "f", 2.5, 8).select("q", "f", F.round("p", 9).alias("p"))


@query("""WITH v AS (SELECT row_number() OVER () AS id, l_extendedprice / 1e6 AS kick, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 500 END AS go, l_tax AS punt FROM lineitem),
o AS (SELECT id, 'kick' AS name, 0 AS i, kick AS v FROM v UNION ALL SELECT id, 'go', 1, go FROM v WHERE go IS NOT NULL UNION ALL SELECT id, 'punt', 2, punt FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) AS rn FROM o), x AS (SELECT id, max(name) FILTER (WHERE rn = 1) AS best, max(v) FILTER (WHERE rn = 1) AS best_value, max(name) FILTER (WHERE rn = 2) AS second, max(v) FILTER (WHERE rn = 1) - max(v) FILTER (WHERE rn = 2) AS gap FROM r GROUP BY id)
SELECT best, second, CASE WHEN gap < 0.01 THEN 'toss-up' WHEN gap >= 0.03 THEN 'clear' ELSE 'lean' END AS grade, count(*) AS n, round(avg(best_value), 9) AS mean_best, round(max(gap), 9) AS max_gap FROM x GROUP BY ALL""")
def best_option(spark, sf_dir):
    options = {"kick": F.col("l_extendedprice") / 1e6, "go": F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 500), "punt": F.col("l_tax")}
    d = table(spark, sf_dir, "lineitem").select(*[c.alias(n) for n, c in plays.decided(options).items()])
    return d.groupBy("best", "second", "grade").agg(F.count("*").alias("n"), F.round(F.avg("best_value"), 9).alias("mean_best"), F.round(F.max("gap"), 9).alias("max_gap"))


@query("""WITH RECURSIVE s AS (SELECT ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS x, y FROM (SELECT (o_custkey % 89 + 1) / 91.0 AS p, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)),
n(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM
 (SELECT k, a, b, sum(y - f) AS g0, sum((y - f) * x) AS g1, sum(f * (1 - f)) AS h00, sum(f * (1 - f) * x) AS h01, sum(f * (1 - f) * x * x) AS h11 FROM (SELECT k, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS f FROM n, s WHERE k < 6) GROUP BY k, a, b))
SELECT round(a, 6) AS a, round(b, 6) AS b FROM n WHERE k = 6""")
def platt_fit(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(((F.col("o_custkey") % 89 + 1) / 91.0).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    a, b = plays.platt(x, "p", "y", 6)
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query("""WITH g AS (SELECT n_nationkey % 5 * 10 AS x, n_nationkey // 5 * 30 AS y, n_nationkey * n_nationkey / 600.0 AS v FROM nation), s AS (SELECT event_id, user_id % 45 AS x, event_id % 130 AS y FROM events),
c AS (SELECT event_id, x, y, least(x // 10 * 10, 40) AS x0, least((x + 9) // 10 * 10, 40) AS x1, least(y // 30 * 30, 120) AS y0, least((y + 29) // 30 * 30, 120) AS y1 FROM s),
t AS (SELECT c.*, CASE WHEN x1 > x0 THEN (x - x0) / CAST(x1 - x0 AS DOUBLE) ELSE 0 END AS tx, CASE WHEN y1 > y0 THEN (ln(1 + y) - ln(1 + y0)) / (ln(1 + y1) - ln(1 + y0)) ELSE 0 END AS ty FROM c)
SELECT event_id, round((a.v + (b.v - a.v) * ty) * (1 - tx) + (d.v + (e.v - d.v) * ty) * tx, 6) AS v FROM t JOIN g a ON a.x = x0 AND a.y = y0 JOIN g b ON b.x = x0 AND b.y = y1 JOIN g d ON d.x = x1 AND d.y = y0 JOIN g e ON e.x = x1 AND e.y = y1""")
def interpolated_table(spark, sf_dir):
    k = F.col("n_nationkey")
    grid = table(spark, sf_dir, "nation").select((k % 5 * 10).alias("x"), (F.expr("n_nationkey div 5") * 30).alias("y"), (k * k / 600.0).alias("v"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 45).alias("at_x"), (F.col("event_id") % 130).alias("at_y"))
    return plays.bilinear(grid, "x", "y", "v", rows, "at_x", "at_y", log_y=True).select("event_id", F.round("v", 6).alias("v"))


@query("""WITH x AS (SELECT user_id, event_id, ts, value, sum(CASE WHEN value > 300 THEN 1 ELSE 0 END) OVER w AS stops, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, CAST(max(least(stops, 3)) AS BIGINT) AS used, round(sum(CASE WHEN stops < 3 THEN value ELSE 0 END), 6) AS wasted, arg_max(event_id, (value, -event_id)) AS worst, arg_min(event_id, (ts, event_id)) FILTER (WHERE stops >= 3) AS run_out FROM x GROUP BY user_id""")
def clock_windows(spark, sf_dir):
    """Stops up to the limit, what is lost before it is reached, the worst case, and the first row at the limit."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = table(spark, sf_dir, "events").withColumn("stops", F.sum((F.col("value") > 300).cast("long")).over(w))
    return x.groupBy("user_id").agg(
        F.max(F.least("stops", F.lit(3))).alias("used"),
        F.round(F.sum(F.when(F.col("stops") < 3, F.col("value")).otherwise(0.0)), 6).alias("wasted"),
        F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("worst"),
        F.min_by("event_id", F.when(F.col("stops") >= 3, F.struct("ts", "event_id"))).alias("run_out"),
    )
