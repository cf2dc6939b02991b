"""Windows over an entity's history."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import exact_sum, ratio
from tidemark.operators import windows
from tidemark.plans.registry import query
from tidemark.sources.tables import table

D = "CAST({} AS DECIMAL(18,2))"


@query("""SELECT event_id, count(*) OVER w AS prior, CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS BIGINT) AS prior_buys
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_prior_counts(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("prior"), F.count(F.when(F.col("event_type") == "purchase", 1)).over(w).alias("prior_buys"))


@query(f"""WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, sum({D.format("value")}) AS total FROM events GROUP BY ALL)
SELECT user_id, day, CAST(sum(total) OVER w AS DOUBLE) / count(*) OVER w AS mean_before, count(*) OVER w AS n_before
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def trailing_window_means(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")
    d = table(spark, sf_dir, "events").groupBy("user_id", day).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    w = windows.trailing(["user_id"], ["day"], 5)
    return d.select("user_id", "day", (F.sum("total").over(w).cast("double") / F.count("*").over(w)).alias("mean_before"), F.count("*").over(w).alias("n_before"))


@query(f"""SELECT o_orderkey, CAST(sum({D.format("o_totalprice")}) OVER w AS DOUBLE) AS next_total, count(*) OVER w AS n_next
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def next_n_windows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(1, 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("next_total"), F.count("*").over(w).alias("n_next"))


@query("""SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS BIGINT) AS place,
  count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS smaller FROM part""")
def running_rank_range_frame(spark, sf_dir):
    priced = windows.with_places(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    priced = priced.select("p_partkey", "p_brand", "p_size", (F.col("of") - F.col("below") - F.col("n") + 1).alias("place"))
    return windows.with_places(priced, "p_size", ["p_brand"]).select("p_partkey", "place", F.col("below").alias("smaller"))


@query("""WITH x AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM x)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM y GROUP BY user_id, island""")
def islands_stints(spark, sf_dir):
    runs = windows.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""SELECT event_id, first_value(CASE WHEN value > 150 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_large FROM events""")
def next_valid_row(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("large", F.when(F.col("value") > 150, F.col("value")))
    return e.select("event_id", windows.next_valid("large", ["user_id"], ["ts", "event_id"]).alias("next_large"))


@query(f"""SELECT event_id, CAST(least(sum({D.format("value")}) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 500) AS DOUBLE) AS capped FROM events""")
def cumulative_cap(spark, sf_dir):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.least(F.sum(F.col("value").cast("decimal(18,2)")).over(w), F.lit(500).cast("decimal(18,2)")).cast("double").alias("capped"))


@query("""SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least_from_here FROM events""")
def reverse_running_min(spark, sf_dir):
    w = windows.backward(["user_id"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.min("value").over(w).alias("least_from_here"))


@query("""SELECT event_id, CAST(epoch_us(following) - epoch_us(ts) AS BIGINT) AS gap_us FROM (SELECT *, lead(ts) OVER w AS following, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = 'click' AND next_type = 'purchase'""")
def lead_gap_pairs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"following": F.lead("ts").over(w), "next_type": F.lead("event_type").over(w)})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.where("event_type = 'click' AND next_type = 'purchase'").select("event_id", (us("following") - us("ts")).alias("gap_us"))


@query("""SELECT a.user_id, a.first_at < b.first_at AS click_first, a.first_at AS click_at, b.first_at AS buy_at FROM (SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'click' GROUP BY 1) a
JOIN (SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id""")
def first_events_caught_before(spark, sf_dir):
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    both = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").groupBy("user_id").agg(at("click").alias("click_at"), at("purchase").alias("buy_at"))
    return both.where("click_at is not null and buy_at is not null").select("user_id", (F.col("click_at") < F.col("buy_at")).alias("click_first"), "click_at", "buy_at")


@query("""SELECT user_id, min(CASE WHEN event_type = 'click' THEN ts END) AS click, min(CASE WHEN event_type = 'purchase' THEN ts END) AS purchase, min(CASE WHEN event_type = 'signup' THEN ts END) AS signup FROM events GROUP BY user_id""")
def pivot_first_flag(spark, sf_dir):
    kinds = ["click", "purchase", "signup"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.min("ts")).select("user_id", *kinds)


@query(f"""WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, sum({D.format("o_totalprice")}) AS t FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.y, CAST(a.t AS DOUBLE) AS total, CAST(b.t AS DOUBLE) AS before FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND a.y = b.y + 1""")
def season_shift_lag(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(exact_sum("o_totalprice").alias("total"))
    w = Window.partitionBy("o_custkey").orderBy("y")
    before = F.when(F.lag("y").over(w) == F.col("y") - 1, F.lag("total").over(w))  # no self join: the year before is the row before, or missing
    return y.select("o_custkey", "y", "total", before.alias("before"))


@query(f"""WITH a AS (SELECT user_id, value, date_diff('day', CAST(ts AS DATE), DATE '2024-02-15') AS age FROM events)
SELECT user_id, round(sum(value * pow(0.5, age / 14.0)) / sum(pow(0.5, age / 14.0)), 6) AS projected, count(*) AS n FROM a GROUP BY user_id""")
def recency_weighted_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", windows.half_life(F.date_diff(F.lit("2024-02-15").cast("date"), F.to_date("ts")), 14))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("projected"), F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT user_id, event_id % 2 AS h, value FROM events), m AS (SELECT user_id, CAST(sum({D.format("value")}) FILTER (WHERE h = 0) AS DOUBLE) / count(*) FILTER (WHERE h = 0) AS a, CAST(sum({D.format("value")}) FILTER (WHERE h = 1) AS DOUBLE) / count(*) FILTER (WHERE h = 1) AS b
FROM e GROUP BY user_id HAVING count(*) FILTER (WHERE h = 0) > 0 AND count(*) FILTER (WHERE h = 1) > 0) SELECT round(corr(a, b), 6) AS reliability, count(*) AS n FROM m""")
def split_half_reliability(spark, sf_dir):
    half = lambda h: F.sum(F.when(F.col("event_id") % 2 == h, F.col("value")).cast("decimal(18,2)")).cast("double") / F.nullif(F.count_if(F.col("event_id") % 2 == h), F.lit(0))
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b")).where("a is not null and b is not null")
    return m.agg(F.round(F.corr("a", "b"), 6).alias("reliability"), F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum({D.format("o_totalprice")}) AS t FROM orders GROUP BY ALL),
p AS (SELECT *, count(*) OVER (PARTITION BY m) AS n, rank() OVER (PARTITION BY m ORDER BY t) - 1 AS below FROM m)
SELECT o_custkey, round(sum(CASE WHEN n > 1 THEN below / CAST(n - 1 AS DOUBLE) ELSE 0 END), 6) AS all_play_wins, count(*) AS months FROM p GROUP BY o_custkey""")
def all_play_luck(spark, sf_dir):
    """Wins against every other customer of a month: the number below is a rank, so no pair of customers is made."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_trunc("month", F.col("o_orderdate")).alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    p = windows.with_places(m, "t", ["m"])
    return p.groupBy("o_custkey").agg(F.round(F.sum(F.coalesce(ratio(F.col("below"), F.col("of") - 1), F.lit(0.0))), 6).alias("all_play_wins"), F.count("*").alias("months"))
