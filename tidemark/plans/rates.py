"""Ratings, shrinkage, distributions, probability metrics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.functions.exprs import exact_sum, linear_score, ratio, shrunk, tier_score, wilson_low
from tidemark.operators import joins, walkforward, windows
from tidemark.plans.registry import query
from tidemark.sources.tables import table

#: A probability-like score of a document: from its length, the same in both engines.
SCORE = "(n_chars % 1000) / 1000.0"
SCORED = f"SELECT l.doc_id, lang, CAST({SCORE} AS DOUBLE) AS p, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def scored(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(x, "doc_id").select("doc_id", "lang", (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("p"), "quality")


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 0.5 + l_discount * -10.0 + l_tax * 4.0 AS linear,
 CASE WHEN l_quantity >= 40 THEN 5.0 WHEN l_quantity >= 20 THEN 2.5 ELSE -1.0 END::DOUBLE AS tier FROM lineitem""")
def linear_tier_scores(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", linear_score({"l_quantity": 0.5, "l_discount": -10, "l_tax": 4}).alias("linear"), tier_score(F.col("l_quantity"), [(40, 5), (20, 2.5)], -1).alias("tier"))


@query("""WITH c AS (SELECT s_nationkey, p_brand, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
b AS (SELECT p_brand, sum(q) AS bq, CAST(sum(n) AS BIGINT) AS bn FROM c GROUP BY p_brand)
SELECT s_nationkey, round(sum(CAST(c.q AS DOUBLE)) / sum(n * CASE WHEN bn > n THEN CAST(bq - c.q AS DOUBLE) / (bn - n) END), 6) AS rating, CAST(sum(n) AS BIGINT) AS n FROM c JOIN b ON c.p_brand = b.p_brand GROUP BY s_nationkey""")
def opponent_adjusted_ratings(spark, sf_dir):
    """Quantity against what the brand's other suppliers do: each cell is compared with its brand without itself."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = x.groupBy("s_nationkey", "p_brand").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.count("*").alias("n"))
    w = Window.partitionBy("p_brand")
    c = c.withColumns({"bq": F.sum("q").over(w), "bn": F.sum("n").over(w)})
    others = F.col("n") * ratio(F.col("bq") - F.col("q"), F.col("bn") - F.col("n"))
    return c.groupBy("s_nationkey").agg(F.round(F.sum(F.col("q").cast("double")) / F.sum(others), 6).alias("rating"), F.sum("n").cast("long").alias("n"))


@query("""WITH g AS (SELECT c_mktsegment AS s, c_nationkey AS k, count(*) AS n, CAST(count(CASE WHEN c_acctbal > 5000 THEN 1 END) AS BIGINT) AS h FROM customer GROUP BY ALL),
t AS (SELECT CAST(sum(h) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS r FROM g), m AS (SELECT s, (CAST(sum(h) AS DOUBLE) + 50.0 * any_value(r)) / (CAST(sum(n) AS DOUBLE) + 50.0) AS r FROM g, t GROUP BY s)
SELECT g.s AS segment, k AS nationkey, n, round((h + 20.0 * m.r) / (n + 20.0), 9) AS rate FROM g JOIN m ON g.s = m.s""")
def shrunk_lookup_table(spark, sf_dir):
    """Rates by segment and nation, each drawn to its segment's, which is drawn to the whole."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("h"))
    levels = g.groupBy("segment").agg(F.sum("h").alias("sh"), F.sum("n").alias("sn"))
    every = Window.partitionBy()
    levels = levels.withColumn("r", shrunk(F.col("sh"), F.col("sn"), F.sum("sh").over(every).cast("double") / F.sum("sn").over(every), 50))
    return g.join(levels, "segment").select("segment", "nationkey", "n", F.round(shrunk(F.col("h"), F.col("n"), F.col("r"), 20), 9).alias("rate"))


@query("""WITH x AS (SELECT l_returnflag AS f, l_quantity AS v, sum(CAST(l_tax * 100 AS BIGINT)) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY f ORDER BY v) AS cw, sum(w) OVER (PARTITION BY f) AS tw FROM x)
SELECT f AS returnflag, min(v) AS weighted_median FROM c WHERE 2 * cw >= tw GROUP BY f""")
def weighted_median(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_quantity").alias("v")).agg(F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("w"))
    by = Window.partitionBy("returnflag")
    c = x.withColumns({"cw": F.sum("w").over(by.orderBy("v")), "tw": F.sum("w").over(by)})
    return c.where("2 * cw >= tw").groupBy("returnflag").agg(F.min("v").alias("weighted_median"))


@query("""SELECT l_returnflag, quantile_disc(l_extendedprice, 0.1) AS low, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_disc(l_extendedprice, 0.9) AS high FROM lineitem GROUP BY l_returnflag""")
def residual_quantile_ranges(spark, sf_dir):
    return windows.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], {"low": 0.1, "high": 0.9}, {"mid": 0.5})


@query("""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def pooled_levels_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), exact_sum("o_totalprice").alias("total"))


@query("""SELECT user_id, CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS BIGINT) AS top, count(*) AS n, CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) / count(*) AS rate FROM events GROUP BY user_id""")
def numerator_sample_career(spark, sf_dir):
    """Numerators and samples by week merge to a career's: the ratio is taken last."""
    week = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("w")).agg(F.count_if(F.col("event_type") == "purchase").alias("top"), F.count("*").alias("n"))
    return week.groupBy("user_id").agg(F.sum("top").alias("top"), F.sum("n").alias("n")).withColumn("rate", ratio(F.col("top"), F.col("n")))


@query("""WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, count(CASE WHEN c_acctbal > 9000 THEN 1 END) AS h FROM customer GROUP BY 1)
SELECT s AS segment, round((CAST(h AS DOUBLE) / n + 3.8416 / (2 * n) - 1.96 * sqrt(CAST(h AS DOUBLE) / n * (1 - CAST(h AS DOUBLE) / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) AS low FROM g""")
def wilson_intervals(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9000).alias("h"))
    return g.select("segment", F.round(wilson_low(F.col("h"), F.col("n")), 9).alias("low"))


@query("""WITH d AS (SELECT c_mktsegment AS s, CAST(floor(c_acctbal / 500) AS BIGINT) AS v, count(*) AS n FROM customer GROUP BY ALL), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY s) AS BIGINT) AS t FROM d)
SELECT a.s AS a, b.s AS b, round(CAST(sum(CASE WHEN a.v > b.v THEN 2 WHEN a.v = b.v THEN 1 ELSE 0 END * a.n * b.n) AS DOUBLE) / (2.0 * any_value(a.t) * any_value(b.t)), 9) AS p FROM c a JOIN c b ON a.s < b.s GROUP BY ALL""")
def prob_a_beats_b(spark, sf_dir):
    """P(A > B) + P(A = B) / 2 between segments: a segment's atoms meet the other's running sums, by an equal bin, never customers or pairs of bins."""
    v = F.floor(F.col("c_acctbal") / 500)
    d = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("s"), v.alias("v")).agg(F.count("*").alias("n"))
    d = joins.complete(d, [d.select("s").distinct(), d.select("v").distinct()], {"n": 0})
    w = Window.partitionBy("s")
    d = d.withColumns({"t": F.sum("n").over(w), "under": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")})
    other = d.select("v", F.col("s").alias("o_s"), F.col("n").alias("o_n"), F.col("under").alias("o_under"), F.col("t").alias("o_t"))
    pairs = d.join(other, "v").where("s < o_s").groupBy(F.col("s").alias("a"), F.col("o_s").alias("b"))
    return pairs.agg(F.round(F.sum(F.col("n") * (2 * F.col("o_under") + F.col("o_n"))).cast("double") / (2.0 * F.max("t") * F.max("o_t")), 9).alias("p"))


@query("""WITH d AS (SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT a.q, round(sum(b.n * exp(-0.5 * pow((a.q - b.q) / 2.0, 2))) / sum(exp(-0.5 * pow((a.q - b.q) / 2.0, 2))), 6) AS smooth FROM d a JOIN d b ON abs(a.q - b.q) <= 6 GROUP BY a.q""")
def kernel_smoothed_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("q")).agg(F.count("*").alias("n"))
    band = d.select(F.explode(F.sequence(F.col("q") - 6, F.col("q") + 6)).alias("at"), F.col("q").alias("near"), "n")
    k = F.exp(-0.5 * F.pow((F.col("q") - F.col("near")) / 2.0, 2))
    return d.select("q").join(band, F.col("q") == F.col("at")).groupBy("q").agg(F.round(F.sum(F.col("n") * k) / F.sum(k), 6).alias("smooth"))


@query(f"""SELECT lang, CAST(sum(quality) AS BIGINT) AS hits, count(*) AS n, CAST(sum(quality) AS DOUBLE) / count(*) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS place FROM ({SCORED})) WHERE place <= 10 GROUP BY lang""")
def precision_at_k(spark, sf_dir):
    return metrics.precision_at(scored(spark, sf_dir), ["lang"], "p", "quality", "doc_id", 10)


@query(f"""SELECT lang, bin, count(*) AS n, CAST(sum(quality) AS BIGINT) AS pos FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) - 1) * 5 / CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE)) AS BIGINT) AS bin FROM ({SCORED})) GROUP BY ALL""")
def calibration_equal(spark, sf_dir):
    return metrics.equal_count_bins(scored(spark, sf_dir), "p", "doc_id", 5, ["lang"]).groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("pos"))


@query(f"""SELECT b.bin, count(s.p) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS pos FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN ({SCORED}) s ON CAST(floor(p * 20) AS BIGINT) = b.bin GROUP BY b.bin""")
def calibration_fixed(spark, sf_dir):
    return metrics.calibration(scored(spark, sf_dir), "p", "quality", 20)


@query(f"""SELECT round(avg((p - quality) * (p - quality)), 9) AS brier, round(-avg(quality * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - quality) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))), 9) AS log_loss, count(*) AS n FROM ({SCORED})""")
def brier_logloss(spark, sf_dir):
    p, y = F.col("p"), F.col("quality")
    return scored(spark, sf_dir).agg(F.round(metrics.brier(p, y), 9).alias("brier"), F.round(metrics.log_loss(p, y), 9).alias("log_loss"), F.count("*").alias("n"))


@query(f"""WITH s AS ({SCORED}) SELECT CAST(sum(CASE WHEN a.p > b.p THEN 2 WHEN a.p = b.p THEN 1 ELSE 0 END) AS DOUBLE) / (2 * count(*)) AS roc_auc FROM s a, s b WHERE a.quality = 1 AND b.quality = 0""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), "p", "quality")


@query(f"""WITH s AS (SELECT p, CAST(sum(quality) AS BIGINT) AS pos, count(*) AS n FROM ({SCORED}) GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS t FROM s)
SELECT round(sum(CAST(pos AS DOUBLE) / CAST(t AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(seen AS DOUBLE)), 9) AS average_precision FROM c""")
def pr_auc(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), "p", "quality")


@query()
def walk_forward_logit(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 4).cast("int"))
    return walkforward.folds(rows, "fold", ["p"], "quality", 2, 3)
