"""As-of views, availability rules, joins in time, audits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import exact_sum, flag
from tidemark.operators import asof, entity, joins, model, store, windows
from tidemark.plans.registry import query
from tidemark.sources.tables import table

AS_OF = "1999-06-30"
LAG = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 5 ELSE 9 END"
#: The order date plus a lag by priority, as both engines write it.
AVAILABLE = f"o_orderdate + make_dt_interval({LAG})"
AVAILABLE_SQL = f"o_orderdate + to_days({LAG})"
RULES = {
    "orders": asof.Rule("event", AVAILABLE),
    "customer": asof.Rule("static"),
    "nation": asof.Rule("static"),
    "lineitem": asof.Rule("event", "l_shipdate + interval 1 day", masks={"l_returnflag": "l_shipdate + interval 60 day"}),
}


def loaders(sf_dir, *names):
    return {n: lambda s, n=n: table(s, sf_dir, n) for n in names}


@query(f"""SELECT n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE {AVAILABLE_SQL} <= TIMESTAMP '{AS_OF} 23:59:59.999999' GROUP BY n_name""")
def asof_orders_by_nation(spark, sf_dir):
    session = asof.AsOfSession(spark, loaders(sf_dir, "orders", "customer", "nation"), RULES, AS_OF)
    return session.sql("""SELECT n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_shipdate + INTERVAL 60 DAY <= TIMESTAMP '{AS_OF} 23:59:59.999999' THEN l_returnflag END AS l_returnflag
FROM lineitem WHERE l_shipdate + INTERVAL 1 DAY <= TIMESTAMP '{AS_OF} 23:59:59.999999'""")
def asof_masked_view(spark, sf_dir):
    session = asof.AsOfSession(spark, loaders(sf_dir, "lineitem"), RULES, AS_OF)
    return session.sql("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")


@query(f"""SELECT c_custkey, c_nationkey FROM customer JOIN (SELECT o_custkey, min({AVAILABLE_SQL}) AS first_at FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
WHERE first_at <= TIMESTAMP '{AS_OF} 23:59:59.999999'""")
def asof_hindsight_allowlist(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.expr(AVAILABLE)).alias("available_at"))
    seen = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"))
    return asof.Rule("hindsight", allowed=("c_custkey", "c_nationkey")).view(seen, AS_OF)


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events
WHERE ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-10 00:00:00' AND ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-17 00:00:00' GROUP BY user_id""")
def outcomes_after_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("available_at", F.expr("ts + interval 6 hour"))
    return asof.outcomes(e, "2024-01-10T00:00:00+00:00", "2024-01-17T00:00:00+00:00").groupBy("user_id").agg(F.count("*").alias("n"), exact_sum("value").alias("total"))


@query(f"SELECT o_orderpriority, count(*) AS n, min({AVAILABLE_SQL}) AS first_at, max({AVAILABLE_SQL}) AS last_at FROM orders GROUP BY o_orderpriority")
def availability_branches(spark, sf_dir):
    at = F.expr(AVAILABLE)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


@query("""WITH w AS (SELECT DISTINCT date_trunc('week', ts) AS week FROM events)
SELECT CAST(week AS TIMESTAMP) AS week, CAST(lag(week) OVER (ORDER BY week) AS TIMESTAMP) AS previous, CAST(lead(week) OVER (ORDER BY week) AS TIMESTAMP) AS following,
       week = max(week) OVER (PARTITION BY year(week)) AS last_of_year FROM w""")
def calendar_weeks(spark, sf_dir):
    weeks = table(spark, sf_dir, "events").select(F.date_trunc("week", F.col("ts")).cast("timestamp_ntz").alias("week")).distinct()
    w = Window.orderBy("week")  # one row a week of the calendar, whatever the events are
    last = F.col("week") == F.max("week").over(Window.partitionBy(F.year("week")))
    return weeks.select("week", F.lag("week").over(w).alias("previous"), F.lead("week").over(w).alias("following"), last.alias("last_of_year"))


_SPANS = [(k, f"2024-01-{1 + 5 * k:02d} 12:00:00", f"2024-01-{6 + 5 * k:02d} 12:00:00") for k in range(5)]


@query(f"""WITH s(span, a, b) AS (VALUES {", ".join(f"(CAST({k} AS BIGINT), TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, a, b in _SPANS)})
SELECT span, event_type, count(*) AS n FROM events JOIN s ON ts > a AND ts <= b GROUP BY span, event_type""")
def event_to_week_interval(spark, sf_dir):
    spans = spark.createDataFrame(_SPANS, "span long, a string, b string").select("span", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    held = joins.interval_join(table(spark, sf_dir, "events"), "ts", spans, "a", "b", 86_400)
    return held.groupBy("span", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT l.event_id, l.user_id, r.value AS prior_value, r.event_id AS prior_event_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_join_latest_earlier(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left, right = e.where("event_type = 'purchase'").drop("event_type", "value"), e.where("event_type <> 'purchase'").drop("event_type")
    return joins.asof_join(left, right, ["user_id"], "ts", "ts", ["value", "event_id"], strict=True).select("event_id", "user_id", "prior_value", "prior_event_id")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_total_order(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return windows.first_of(table(spark, sf_dir, "orders"), ["o_custkey"], [status, F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE c > 1) AS n_repeated,
       CAST(coalesce(sum(c) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS n_null_rows FROM k""")
def pk_audit(spark, sf_dir):
    return model.key_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT role, id, count(*) AS n FROM (SELECT 'part' AS role, l_partkey AS id FROM lineitem UNION ALL SELECT 'supplier', l_suppkey FROM lineitem) GROUP BY role, id""")
def home_away_melt(spark, sf_dir):
    return joins.melt(table(spark, sf_dir, "lineitem"), {"part": "l_partkey", "supplier": "l_suppkey"}, []).groupBy("role", "id").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nationkey, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM c FULL JOIN s ON c.k = s.k""")
def full_outer_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nationkey", "full").fillna(0, ["n_customers", "n_suppliers"])


@query("""SELECT n_nationkey, c_mktsegment, coalesce(n, 0) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)
LEFT JOIN (SELECT c_nationkey, c_mktsegment AS m, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY ALL) ON n_nationkey = c_nationkey AND c_mktsegment = m""")
def grid_zero_fill(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    some = c.where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    return joins.complete(some, [table(spark, sf_dir, "nation").select("n_nationkey"), c.select("c_mktsegment").distinct()], {"n": 0})


@query("""SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS vacated, count(*) AS n FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY c_nationkey""")
def anti_vacated_share(spark, sf_dir):
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= asof.stamp("2000-01-01T00:00:00+00:00"))
    gone = table(spark, sf_dir, "customer").join(late, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return gone.groupBy("c_nationkey").agg(exact_sum("c_acctbal").alias("vacated"), F.count("*").alias("n"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, CAST(count(DISTINCT CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN user_id END) AS DOUBLE) / count(DISTINCT user_id) AS share
FROM events GROUP BY event_type""")
def semi_filter_share(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    buyers = e.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer")).distinct()
    both = e.select("event_type", "user_id").distinct().join(buyers, F.col("user_id") == F.col("buyer"), "left")
    return both.groupBy("event_type").agg(F.count("user_id").alias("users"), (F.count("buyer") / F.count("user_id")).alias("share"))


@query("""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS k FROM orders),
r AS (SELECT DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS k FROM orders), g AS (SELECT k, row_number() OVER (ORDER BY k NULLS FIRST) AS grade FROM r)
SELECT f.k AS priority, any_value(grade) AS grade, count(*) AS n FROM f JOIN g ON f.k IS NOT DISTINCT FROM g.k GROUP BY f.k""")
def null_safe_link(spark, sf_dir):
    """Priorities, null among them, linked to their grade: the side with repeated keys, a null one too, is counted before the join."""
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority")
    f = table(spark, sf_dir, "orders").groupBy(key).agg(F.count("*").alias("n"))
    grades = f.select("priority", F.row_number().over(Window.orderBy(F.col("priority").asc_nulls_first())).cast("long").alias("grade"))  # one row a priority
    return joins.null_safe(f, grades, ["priority"]).select("priority", "grade", "n")


@query("""SELECT event_id, value > 100 AS large, coalesce(event_type = 'purchase' AND value > 50, false) AS big_buy, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0, false) AS even_k FROM events""")
def flag_situations(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") > 100).alias("large"), flag((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("big_buy"), flag(k % 2 == 0).alias("even_k"))


@query("""SELECT regexp_replace(trim(CAST(CAST(c_custkey AS DOUBLE) AS VARCHAR)), '\\.0+$', '') AS id, c_name FROM customer""")
def id_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(entity.canonical(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 "))).alias("id"), "c_name")


@query("""WITH c AS (SELECT 'customer' AS id_type, c_custkey % 400 AS source_id, c_custkey // 2 AS entity, (c_custkey // 40) % 3 AS p FROM customer),
b AS (SELECT id_type, source_id, min(p) AS p FROM c GROUP BY ALL)
SELECT c.id_type, c.source_id, CASE WHEN min(entity) = max(entity) THEN min(entity) END AS entity, count(DISTINCT entity) AS n_entities
FROM c JOIN b ON c.id_type = b.id_type AND c.source_id = b.source_id AND c.p = b.p GROUP BY ALL""")
def bridge_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    c = c.select(F.lit("customer").alias("id_type"), (F.col("c_custkey") % 400).alias("source_id"), F.expr("c_custkey div 2").alias("entity"), (F.expr("c_custkey div 40") % 3).alias("p"))
    return entity.bridge(c, "id_type", "source_id", "entity", "p")


@query("""WITH a AS (SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey, rank() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CAST(a.r AS BIGINT) AS old, CAST(b.r AS BIGINT) AS new, CASE WHEN a.r IS NULL THEN 'new' WHEN b.r IS NULL THEN 'gone' WHEN a.r = b.r THEN 'same' ELSE 'moved' END AS state
FROM (SELECT * FROM a WHERE r <= 50) a FULL JOIN (SELECT * FROM b WHERE r <= 50) b ON a.p_partkey = b.p_partkey""")
def list_compare_timemachine(spark, sf_dir):
    p = table(spark, sf_dir, "part")

    def top(by):
        first = p.orderBy(F.col(by).desc(), "p_partkey").limit(50)
        return first.select("p_partkey", F.row_number().over(Window.orderBy(F.col(by).desc(), "p_partkey")).cast("long").alias("place"))

    return store.compared(top("p_retailprice"), top("p_size"), ["p_partkey"], "place")


_LATE_ORDERS = f"SELECT o_orderpriority AS k, o_totalprice AS v, {AVAILABLE_SQL} > TIMESTAMP '{AS_OF} 23:59:59.999999' AS late FROM orders"
_LATE_LINES = f"SELECT l_linenumber AS k, l_returnflag AS v, l_shipdate + INTERVAL 60 DAY > TIMESTAMP '{AS_OF} 23:59:59.999999' AS late FROM lineitem WHERE l_shipdate + INTERVAL 1 DAY <= TIMESTAMP '{AS_OF} 23:59:59.999999'"


@query(f"""WITH o AS ({_LATE_ORDERS}), l AS ({_LATE_LINES}),
s AS (SELECT k, count(*) AS n, sum(CAST(v AS DECIMAL(18,2))) AS a, sum(CAST(v AS DECIMAL(18,2))) FILTER (WHERE NOT late) AS b, count(*) FILTER (WHERE NOT late) AS m,
        sum(CAST(CASE WHEN late THEN -v - 1 ELSE v END AS DECIMAL(18,2))) AS c FROM o GROUP BY k),
f AS (SELECT k, count(*) FILTER (WHERE v = 'R') AS a, count(*) FILTER (WHERE CASE WHEN late THEN '~' || v ELSE v END = 'R') AS c FROM l GROUP BY k)
SELECT 'raw total' AS build, 'deleted' AS variant, CAST(sum(CASE WHEN m = 0 THEN 1 WHEN a <> b THEN 2 ELSE 0 END) AS BIGINT) AS n FROM s
UNION ALL SELECT 'raw total', 'scrambled', CAST(sum(CASE WHEN a <> c THEN 2 ELSE 0 END) AS BIGINT) FROM s
UNION ALL SELECT 'raw flags', 'scrambled', CAST(sum(CASE WHEN a <> c THEN 2 ELSE 0 END) AS BIGINT) FROM f""")
def leakage_invariance(spark, sf_dir):
    """Rows that builds give differently without the future: an as-of one none, one that reads the raw table, and one that reads a column before it is public, many."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "lineitem")}

    def fair(world):
        o = world.view("orders").join(world.view("customer"), F.col("o_custkey") == F.col("c_custkey")).join(world.view("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        flags = world.view("lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("total"))
        return o.groupBy(F.col("n_name").alias("k")).agg(exact_sum("o_totalprice").alias("total")).unionAll(flags)

    def raw_total(world):
        return world.raw("orders").groupBy(F.col("o_orderpriority").alias("k")).agg(exact_sum("o_totalprice").alias("total"))

    def raw_flags(world):
        shown = world.raw("lineitem").where(F.expr("l_shipdate + interval 1 day") <= asof.stamp(AS_OF))
        return shown.groupBy(F.col("l_linenumber").cast("string").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("total"))

    out = None
    for name, build in (("fair", fair), ("raw total", raw_total), ("raw flags", raw_flags)):
        found = asof.invariant(build, tables, RULES, AS_OF).groupBy(F.lit(name).alias("build"), "variant").agg(F.count("*").alias("n"))
        out = found if out is None else out.unionAll(found)
    return out


@query("""SELECT count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS hash FROM (SELECT md5(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS h FROM nation)""")
def content_hash_audit(spark, sf_dir):
    """The hash of a small table in a form that any engine can repeat; content_hash() of operators.model has no sort and suits large ones."""
    return model.portable_hash(table(spark, sf_dir, "nation"))
