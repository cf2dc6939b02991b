"""Entity ids: candidates, bridges, passes, checks, coverage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import entity
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_CAND = """SELECT 'a' AS id_type, CAST(o_custkey AS VARCHAR) AS source_id, o_custkey % 50 AS entity, year(o_orderdate) AS s, 1 AS rank FROM orders UNION ALL
SELECT 'b', CAST(o_orderkey % 90 AS VARCHAR), o_custkey % 50, year(o_orderdate), 1 FROM orders UNION ALL SELECT 'a', CAST(user_id AS VARCHAR), user_id % 60, 2024, 2 FROM events"""


def _candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 90).cast("double").alias("other"), (F.col("o_custkey") % 50).alias("e"), F.year("o_orderdate").alias("s"))
    e = table(spark, sf_dir, "events").select("user_id", (F.col("user_id") % 60).alias("e"), F.lit(2024).alias("s"))
    return entity.candidates(o, {"a": "o_custkey", "b": "other"}, "e", "orders", 1, "s").unionByName(entity.candidates(e, {"a": "user_id"}, "e", "events", 2, "s"))


@query(f"SELECT id_type, source_id, entity, CASE rank WHEN 1 THEN 'orders' ELSE 'events' END AS method, CAST(min(s) AS INTEGER) AS first_season, CAST(max(s) AS INTEGER) AS last_season FROM ({_CAND}) GROUP BY ALL")
def id_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).drop("rank")


@query(f"""WITH c AS (SELECT DISTINCT id_type, source_id, entity, rank FROM ({_CAND})) SELECT id_type, source_id, string_agg(rank || ':' || entity, ' ' ORDER BY rank, CAST(entity AS VARCHAR)) AS named FROM c GROUP BY ALL HAVING count(DISTINCT entity) > 1""")
def id_conflicts(spark, sf_dir):
    return entity.conflicts(_candidates(spark, sf_dir))


@query(f"""WITH c AS (SELECT id_type, source_id, entity, rank, max(s) AS last_season FROM ({_CAND}) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY entity, id_type ORDER BY rank, last_season DESC, source_id) AS rn FROM c)
SELECT entity, max(source_id) FILTER (WHERE id_type = 'a') AS a, max(source_id) FILTER (WHERE id_type = 'b') AS b FROM p WHERE rn = 1 GROUP BY entity""")
def dim_id_pick(spark, sf_dir):
    return entity.pick(_candidates(spark, sf_dir)).groupBy("entity").pivot("id_type", ["a", "b"]).agg(F.max("source_id"))


_LEFT = "SELECT p_partkey AS l, regexp_replace(p_name, ' ', '-') || CASE WHEN p_partkey % 5 = 0 THEN ' Jr.' ELSE '' END AS name, p_size % 5 AS grp, p_partkey % 40 AS year, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS born FROM part"
_RIGHT = "SELECT p_partkey + 10000 AS r, upper(p_name) AS name, p_size % 5 AS grp, p_partkey % 40 AS year, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS born FROM part WHERE p_partkey % 4 > 0"
_KEY = "regexp_replace(regexp_replace(lower(name), '-', ' ', 'g'), ' jr.$', '')"


@query(f"""WITH a0 AS (SELECT *, {_KEY} AS k FROM ({_LEFT})), b0 AS (SELECT *, {_KEY} AS k FROM ({_RIGHT})),
la AS (SELECT k, born, min(l) AS l FROM a0 WHERE born IS NOT NULL GROUP BY ALL HAVING count(*) = 1), ra AS (SELECT k, born, min(r) AS r FROM b0 WHERE born IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
pa AS (SELECT l, r FROM la JOIN ra USING (k, born)), rest AS (SELECT * FROM a0 WHERE l NOT IN (SELECT l FROM pa)),
lb AS (SELECT k, grp, year, min(l) AS l FROM rest GROUP BY ALL HAVING count(*) = 1), rb AS (SELECT k, grp, year, min(r) AS r FROM b0 GROUP BY ALL HAVING count(*) = 1),
pb AS (SELECT lb.l, rb.r FROM lb JOIN rb USING (k, grp, year) JOIN rest ON rest.l = lb.l JOIN b0 ON b0.r = rb.r WHERE coalesce(rest.born = b0.born, true))
SELECT l AS left_id, r AS right_id, 'a' AS pass FROM pa UNION ALL SELECT l, r, 'b' FROM pb""")
def name_pass_links(spark, sf_dir):
    """By name and birth, then by name, group and year where births don't contradict; only keys that are unique on both sides link."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    left = p.select(key.alias("l"), F.concat(F.regexp_replace("p_name", " ", "-"), F.when(key % 5 == 0, " Jr.").otherwise("")).alias("name"), (size % 5).alias("grp"), (key % 40).alias("year"), F.when(key % 3 > 0, size).alias("born"))
    right = p.where(key % 4 > 0).select((key + 10000).alias("r"), F.upper("p_name").alias("name"), (size % 5).alias("grp"), (key % 40).alias("year"), F.when(key % 7 > 0, size).alias("born"))
    named = lambda df: df.withColumn("k", entity.name_key(F.col("name")))
    return entity.two_pass_links(named(left), named(right), "l", "r", ["k", "born"], ["k", "grp", "year"], "born")


@query("""WITH u AS (SELECT 'a' AS id_type, CAST(o_custkey AS VARCHAR) AS source_id, o_custkey % 100 AS entity, year(o_orderdate) AS s FROM orders), c AS (SELECT c_custkey AS entity, 1995 + c_nationkey % 3 AS f, 2001 - c_nationkey % 2 AS t FROM customer WHERE c_custkey < 80)
SELECT id_type, source_id, u.entity, CAST(min(s) AS INTEGER) AS used_first, CAST(max(s) AS INTEGER) AS used_last, min(s) >= any_value(f) AND max(s) <= any_value(t) AS valid FROM u LEFT JOIN c ON u.entity = c.entity GROUP BY ALL""")
def id_usage_checks(spark, sf_dir):
    usage = table(spark, sf_dir, "orders").select(F.lit("a").alias("id_type"), F.col("o_custkey").cast("string").alias("source_id"), (F.col("o_custkey") % 100).alias("entity"), F.year("o_orderdate").alias("season"))
    careers = table(spark, sf_dir, "customer").where("c_custkey < 80").select(F.col("c_custkey").alias("entity"), (1995 + F.col("c_nationkey") % 3).alias("first_season"), (2001 - F.col("c_nationkey") % 2).alias("last_season"))
    return entity.usage_check(usage, careers)


@query("""SELECT event_type, CAST(day(ts) <= 10 AS INTEGER) AS early, count(*) AS n, count(c_custkey) AS n_linked, count(DISTINCT c_custkey) AS n_entities, round(count(c_custkey) / count(*), 6) AS share FROM events LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment <> 'MACHINERY' GROUP BY ALL""")
def id_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey")
    e = table(spark, sf_dir, "events").withColumn("early", (F.day("ts") <= 10).cast("int")).join(c, F.col("c_custkey") == F.col("user_id"), "left")
    return entity.coverage(e, ["event_type", "early"], "c_custkey")


@query("""WITH p AS (SELECT page_id, CASE WHEN url LIKE '%example.com/%' THEN 'weekly' WHEN regexp_matches(url, 'net/(en|de)/[0-9]+') THEN 'season' WHEN url LIKE '%org%' THEN 'preseason' ELSE 'other' END AS kind, nullif(upper(regexp_extract(url, '/([a-z]{2})/', 1)), '') AS pos FROM pages)
SELECT kind, pos, n, rank() OVER (PARTITION BY kind ORDER BY n DESC, pos) <= 2 AS in_pool FROM (SELECT kind, pos, count(*) AS n FROM p GROUP BY kind, pos)""")
def page_classifier(spark, sf_dir):
    """Pages by the first pattern that their address fits, positions from it, and the most frequent positions of a kind."""
    u = F.col("url")
    kind = F.when(u.contains("example.com/"), "weekly").when(u.rlike("net/(en|de)/[0-9]+"), "season").when(u.like("%org%"), "preseason").otherwise("other")
    pos = F.nullif(F.upper(F.regexp_extract(u, "/([a-z]{2})/", 1)), F.lit(""))
    n = table(spark, sf_dir, "pages").groupBy(kind.alias("kind"), pos.alias("pos")).agg(F.count("*").alias("n"))
    place = F.rank().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), F.col("pos").asc_nulls_last()))
    return n.withColumn("in_pool", place <= 2)
