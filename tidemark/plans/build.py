"""Casts, codes, facts with opponents, corrections, manifests over the test tables."""

from pyspark.sql import functions as F

from tidemark.operators import build
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity, CASE WHEN l_returnflag <> 'N' THEN CASE l_returnflag WHEN 'R' THEN 'returned' ELSE l_returnflag END END AS flag, CAST(CASE l_linestatus WHEN 'O' THEN 1 ELSE 3 END AS INTEGER) AS rank,
 l_suppkey % 3 * 12 + l_linenumber AS inches FROM lineitem""")
def typed_projection(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    flag = build.normalized(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(" "), {"R": "returned"})
    height = F.concat_ws("-", (F.col("l_suppkey") % 3).cast("string"), F.col("l_linenumber").cast("string"))
    return x.select("l_orderkey", "l_linenumber", build.strict_cast(x, "l_quantity", "int").alias("quantity"), flag.alias("flag"), build.priority(F.col("l_linestatus"), ["O", "P"]).alias("rank"), build.height_inches(height).cast("long").alias("inches"))


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 13 > 0 THEN o_custkey END AS k, o_orderdate AS d FROM orders), p AS (SELECT k, d, count(*) AS n, count(k) AS m FROM s GROUP BY k, d)
SELECT CAST(sum(n) AS BIGINT) AS staged, CAST(sum(n - m) AS BIGINT) AS without_key, CAST(sum(greatest(m - 1, 0)) AS BIGINT) AS repeated, count(*) FILTER (WHERE m > 0) AS kept FROM p""")
def materialize_account(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey")).alias("k"), F.col("o_orderdate").alias("d"))
    return build.accounted(s, ["k", "d"], ["k"])


@query("""WITH g AS (SELECT l_orderkey AS game, l_returnflag AS team, CAST(sum(l_quantity) AS BIGINT) AS points, count(*) FILTER (WHERE l_tax > 0.05) AS big FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT a.game, a.team, a.points, a.big, b.points AS allowed, b.big AS big_allowed FROM g a LEFT JOIN g b ON a.game = b.game AND a.team <> b.team""")
def defense_week(spark, sf_dir):
    """Each side's figures beside its opponent's."""
    g = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("team")).agg(F.sum("l_quantity").cast("long").alias("points"), F.count_if(F.col("l_tax") > 0.05).alias("big"))
    return build.with_opponent(g, ["game"], "team", {"points": "allowed", "big": "big_allowed"})


@query("""WITH c AS (SELECT n_regionkey AS team, n_name AS name, n_nationkey AS first, n_nationkey + 2 AS last FROM nation WHERE n_nationkey % 5 = n_regionkey AND n_nationkey < 5)
SELECT c_custkey, c_nationkey % 5 AS team, coalesce(name, c_mktsegment) AS who, name IS NOT NULL AS is_corrected FROM customer LEFT JOIN c ON team = c_nationkey % 5 AND c_nationkey BETWEEN first AND last""")
def coach_corrections(spark, sf_dir):
    c = table(spark, sf_dir, "nation").where("n_nationkey % 5 = n_regionkey and n_nationkey < 5").select(F.col("n_regionkey").alias("team"), F.col("n_nationkey").alias("first"), (F.col("n_nationkey") + 2).alias("last"), F.col("n_name").alias("value"))
    x = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("team"), "c_nationkey", F.col("c_mktsegment").alias("who"))
    return build.corrected(x, c, ["team"], "c_nationkey", "who").drop("c_nationkey")


@query("""WITH m AS (SELECT trim(lower(regexp_replace(c, '[^A-Za-z0-9]+', '-', 'g')), '-') AS key, c AS name, o_orderdate AS d FROM (SELECT o_orderpriority AS c, o_orderdate FROM orders UNION ALL SELECT o_orderstatus, o_orderdate FROM orders))
SELECT key, min(name) AS name, count(*) AS n, min(d) AS first_at, max(d) AS last_at FROM m GROUP BY key""")
def coach_dimension(spark, sf_dir):
    """Names of two roles melted in one pass, keyed by slug, with their span."""
    from tidemark.operators import joins

    m = joins.melt(table(spark, sf_dir, "orders"), {"home": "o_orderpriority", "away": "o_orderstatus"}, ["o_orderdate"], value="name")
    return m.groupBy(build.slug(F.col("name")).alias("key")).agg(F.min("name").alias("name"), F.count("*").alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM o_orderstatus) AS n_l_returnflag, count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END) AS n_l_linestatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def enrich_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("closed"))
    x = build.enriched(table(spark, sf_dir, "lineitem"), o, ["l_orderkey"], ["o_orderstatus", "closed"])
    return build.disagreeing(x, {"l_returnflag": "o_orderstatus", "l_linestatus": "closed"})


@query("""WITH l AS (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS k, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 6000)
SELECT s_suppkey, (SELECT CASE WHEN count(*) = 1 THEN min(c_custkey) END FROM l WHERE l.k IS NOT DISTINCT FROM (CASE WHEN s_nationkey <> 3 THEN s_nationkey END) AND abs(c_acctbal - s_acctbal) < 900) AS c_custkey FROM supplier""")
def combine_links(spark, sf_dir):
    """A link only where exactly one candidate fits; null keys are a key."""
    k = lambda c: F.when(F.col(c) != 3, F.col(c)).alias("k")
    links = table(spark, sf_dir, "customer").where("c_acctbal > 6000").select(k("c_nationkey"), "c_custkey", "c_acctbal")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", k("s_nationkey"), "s_acctbal")
    return build.sole_link(rows, links, ["k"], "c_custkey", F.abs(F.col("c_acctbal") - F.col("s_acctbal")) < 900).select("s_suppkey", "c_custkey")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS amount, o_orderstatus AS state, NULL::VARCHAR AS kind FROM orders UNION ALL SELECT CAST(event_id AS VARCHAR) || 'e', CAST(user_id AS DOUBLE), NULL, event_type FROM events""")
def relaxed_concat(spark, sf_dir):
    """Two layouts of one source: columns by name, types widened."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("state"))
    b = table(spark, sf_dir, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("e")).alias("id"), F.col("user_id").cast("int").alias("amount"), F.col("event_type").alias("kind"))
    return build.relaxed_union([a, b])


@query("""SELECT 'orders' AS name, count(*) AS n_rows, CAST(min(year(o_orderdate)) AS INTEGER) AS first_season, CAST(max(year(o_orderdate)) AS INTEGER) AS last_season, '{"dropped": 0}' AS notes FROM orders UNION ALL SELECT 'nation', count(*), NULL, NULL, '{}' FROM nation""")
def build_manifest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    return build.manifest({"orders": o, "nation": table(spark, sf_dir, "nation")}, {"orders": "season"}, {"orders": {"dropped": 0}}).drop("hash")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL""")
def atomic_build(spark, sf_dir):
    """Two builds of a versioned folder; readers see the last whole one."""
    from tidemark.sources.tables import scratch

    v = build.Versions(spark, scratch(spark))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    v.build({"orders": o.where("o_orderstatus = 'F'")})
    v.build({"orders": o}, {"orders": ["o_orderkey"]})
    return v.read("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
