"""Ranked lists, options, pools, shares."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import exact_sum, horizontal_mean
from tidemark.operators import windows
from tidemark.plans.registry import query
from tidemark.plans.rates import SCORED, scored
from tidemark.sources.tables import table


@query("""WITH t AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CAST(t AS DOUBLE) AS total, place FROM (SELECT *, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY t DESC) AS BIGINT) AS place FROM t JOIN customer ON o_custkey = c_custkey WHERE n >= 5) WHERE place <= 5""")
def competition_rank_pool(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"), F.count("*").alias("n")).where("n >= 5")
    pool = t.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.col("t").desc())).cast("long")
    return pool.withColumn("place", place).where("place <= 5").select("o_custkey", F.col("t").cast("double").alias("total"), "place")


@query("""SELECT c_custkey, rn <= ceil(0.1 * n) AS top_decile, rn > n - ceil(0.1 * n) AS bottom_decile FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""")
def decile_tags(spark, sf_dir):
    x = windows.ordinal(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", ["c_mktsegment"], descending=True)
    k = F.ceil(F.lit(0.1) * F.col("of"))
    return x.select("c_custkey", (F.col("rn") <= k).alias("top_decile"), (F.col("rn") > F.col("of") - k).alias("bottom_decile"))


@query(f"""WITH g AS (SELECT CAST(t AS BIGINT) AS t FROM (SELECT unnest(range(1, 20)) AS t)), s AS (SELECT CAST(floor(p * 20) AS BIGINT) AS b, count(*) AS n, CAST(sum(quality) AS BIGINT) AS h FROM ({SCORED}) GROUP BY 1)
SELECT t AS threshold, CAST(sum(n) AS BIGINT) AS flagged, CAST(sum(h) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS precision FROM g JOIN s ON b >= t GROUP BY t ORDER BY precision DESC, t LIMIT 1""")
def threshold_grid_search(spark, sf_dir):
    """Rows meet the grid as counts per step; suffix sums give every threshold at once."""
    s = scored(spark, sf_dir).groupBy(F.floor(F.col("p") * 20).alias("b")).agg(F.count("*").alias("n"), F.sum("quality").alias("h"))
    grid = spark.range(1, 20).withColumnRenamed("id", "threshold")
    met = grid.join(F.broadcast(s), F.col("b") >= F.col("threshold")).groupBy("threshold").agg(F.sum("n").alias("flagged"), F.sum("h").alias("hits"))
    return met.select("threshold", "flagged", (F.col("hits") / F.col("flagged")).alias("precision")).orderBy(F.col("precision").desc(), "threshold").limit(1)


@query("""SELECT s_suppkey, (rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 - 0.5) / count(*) OVER () AS percentile FROM supplier""")
def average_rank_percentile(spark, sf_dir):
    x = windows.with_places(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", [])
    return x.select("s_suppkey", ((F.col("below") + F.col("n") / 2.0) / F.col("of")).alias("percentile"))


@query("""SELECT DISTINCT o_orderpriority, role, id FROM (SELECT o_orderpriority, 'part' AS role, l_partkey AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL
SELECT o_orderpriority, 'supplier', l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def unpivot_roles_distinct(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("o_orderpriority", F.expr("stack(2, 'part', l_partkey, 'supplier', l_suppkey) as (role, id)")).distinct()


@query("""SELECT label, CAST(i - 1 AS BIGINT) AS pos, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 4) AS total FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
def explode_arrays_zip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 4).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a >= b AND a >= c THEN 'price' WHEN b >= c THEN 'quantity' ELSE 'tax' END AS best, greatest(a, b, c) AS best_value FROM
(SELECT *, l_extendedprice / 1000.0 AS a, CAST(l_quantity AS DOUBLE) AS b, l_tax * 500.0 AS c FROM lineitem)""")
def list_argmax_best_option(spark, sf_dir):
    a, b, c = F.col("l_extendedprice") / 1000.0, F.col("l_quantity"), F.col("l_tax") * 500.0
    best = F.when((a >= b) & (a >= c), "price").when(b >= c, "quantity").otherwise("tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", best.alias("best"), F.greatest(a, b, c).alias("best_value"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(b.r - a.r AS BIGINT) AS gap FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND b.r > a.r AND b.r <= a.r + 2""")
def pairwise_rank_gap(spark, sf_dir):
    """Neighbours within two places are leads of one ordered window, not a self join."""
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    near = F.array(*[F.struct(F.lead("s_suppkey", g).over(w).alias("b"), F.lit(g).cast("long").alias("gap")) for g in (1, 2)])
    near = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), near.alias("near"))
    return near.select("a", F.inline("near")).where("b is not null")


@query("""SELECT doc_id, CAST(to_json(list_transform(list_sort(list_filter([{'v': -CAST(n_chars % 97 AS BIGINT), 'k': 'length'}, {'v': -CAST(doc_id % 89 AS BIGINT), 'k': 'id'}, {'v': -CAST(length(source) AS BIGINT), 'k': 'source'}], lambda x: x.v < 0))[1:2], lambda x: {'reason': x.k, 'size': -x.v})) AS VARCHAR) AS reasons FROM documents""")
def json_reasons_topn(spark, sf_dir):
    of = lambda v, k: F.struct((-v).cast("long").alias("v"), F.lit(k).alias("k"))
    parts = F.array(of(F.col("n_chars") % 97, "length"), of(F.col("doc_id") % 89, "id"), of(F.char_length("source"), "source"))
    top = F.slice(F.array_sort(F.filter(parts, lambda x: x["v"] < 0)), 1, 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.transform(top, lambda x: F.struct(x["k"].alias("reason"), (-x["v"]).alias("size")))).alias("reasons"))


@query("""SELECT s_suppkey, (CASE WHEN s_acctbal > 0 THEN s_acctbal END IS NULL) AS no_balance, coalesce((CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END + s_nationkey) / (CASE WHEN s_acctbal > 0 THEN 2 ELSE 1 END), 0) AS mean FROM supplier""")
def horizontal_means(spark, sf_dir):
    good = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", good.isNull().alias("no_balance"), horizontal_mean(good, F.col("s_nationkey")).alias("mean"))


@query("""SELECT l_returnflag, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / any_value(t) AS share FROM lineitem JOIN (SELECT l_returnflag AS f, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS t FROM lineitem GROUP BY 1) ON f = l_returnflag GROUP BY ALL""")
def allocation_shares(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("part"))
    whole = x.groupBy("l_returnflag").agg(F.sum("part").cast("double").alias("all"))
    return x.join(whole, "l_returnflag").select("l_returnflag", "l_suppkey", (F.col("part").cast("double") / F.col("all")).alias("share"))
