"""Evaluation: bands, pooled precision, bootstrap, isotonic bins, reliability, stored predictions."""

from pyspark.sql import functions as F

from tidemark.functions import metrics, resample
from tidemark.functions.exprs import ratio
from tidemark.operators import store, walkforward
from tidemark.plans.rates import SCORED, scored
from tidemark.plans.registry import query
from tidemark.sources.tables import scratch, table

#: An evaluation list: per supplier and month, lines ranked by price, a hit if returned.
_LIST = """SELECT CAST(year(l_shipdate) AS INTEGER) AS season, CAST(month(l_shipdate) AS INTEGER) AS week, CAST(l_returnflag = 'R' AS INTEGER) AS hit,
 row_number() OVER (PARTITION BY year(l_shipdate), month(l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem"""


def ranked_lines(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), (F.col("l_returnflag") == "R").cast("int").alias("hit"), "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return metrics.ranked(x, ["season", "week"], "l_extendedprice", "id").select("season", "week", "hit", "place")


@query(f"""WITH g AS (SELECT season, week, count(*) AS n, CAST(sum(hit) FILTER (WHERE place <= 10) AS DOUBLE) / 10 AS p, count(*) < 10 AS short FROM ({_LIST}) GROUP BY ALL)
SELECT round(avg(p), 9) AS precision, count(*) AS n_groups, count(*) FILTER (WHERE short) AS n_short, CAST(sum(n) AS BIGINT) AS n_rows FROM g""")
def pooled_precision(spark, sf_dir):
    return metrics.pooled(metrics.at_k(ranked_lines(spark, sf_dir), ["season", "week"], "hit", 10))


@query(f"""SELECT band, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(hit) AS DOUBLE) / count(*) AS rate FROM (SELECT *, CASE WHEN place BETWEEN 1 AND 5 THEN '1-5' WHEN place BETWEEN 6 AND 10 THEN '6-10' WHEN place BETWEEN 11 AND 25 THEN '11-25' END AS band FROM ({_LIST})) WHERE band IS NOT NULL GROUP BY band""")
def rank_buckets(spark, sf_dir):
    return metrics.bucket_rates(ranked_lines(spark, sf_dir), "hit", [(1, 5), (6, 10), (11, 25)])


_DRAWN = "CAST(('0x' || substr(md5('{seed}-' || draw || '-' || place), 1, 8)) AS BIGINT) % n"


def _bootstrap_sql(per: str, draws: int, seed: int) -> str:
    """per: SQL of (block, s, c); gives the CTEs up to d(draw, mean)."""
    return f"""per AS ({per}), b AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM per),
k AS (SELECT draw, i AS place, n, {_DRAWN.format(seed=seed).replace("place", "i")} AS pick FROM b, (SELECT unnest(range({draws})) AS draw)), d AS (SELECT draw, CAST(sum(s) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS mean FROM k JOIN b ON b.i = k.pick GROUP BY draw)"""


@query(f"WITH {_bootstrap_sql(f'SELECT season AS block, sum(hit) AS s, count(*) AS c FROM ({_LIST}) WHERE place <= 10 GROUP BY season', 400, 7)} SELECT round(quantile_cont(mean, 0.05), 9) AS low, round(quantile_cont(mean, 0.95), 9) AS high, round(avg(CAST(mean > 0 AS INTEGER)), 9) AS above_zero FROM d")
def block_bootstrap(spark, sf_dir):
    """A 90 % interval of precision at 10, whole seasons drawn with replacement."""
    top = ranked_lines(spark, sf_dir).where("place <= 10")
    return resample.interval(resample.block_means(top, "season", "hit", 400, 7), "mean")


@query(f"""WITH g AS (SELECT season, week, avg(hit) FILTER (WHERE place <= 10) - avg(hit) FILTER (WHERE place > 10 AND place <= 30) AS difference FROM ({_LIST}) GROUP BY ALL HAVING count(*) >= 30),
{_bootstrap_sql("SELECT season AS block, sum(difference) AS s, count(difference) AS c FROM g GROUP BY season", 300, 11)}
SELECT round(quantile_cont(mean, 0.05), 9) AS low, round(quantile_cont(mean, 0.95), 9) AS high, round(avg(CAST(mean > 0 AS INTEGER)), 9) AS above_zero FROM d""")
def paired_bootstrap(spark, sf_dir):
    """Two methods on the same weeks: an interval of the mean difference."""
    x = ranked_lines(spark, sf_dir).groupBy("season", "week").agg(F.avg(F.when(F.col("place") <= 10, F.col("hit"))).alias("a"), F.avg(F.when(F.col("place").between(11, 30), F.col("hit"))).alias("b"), F.count("*").alias("n")).where("n >= 30")
    both = resample.paired(x.select("season", "week", F.col("a").alias("v")), x.select("season", "week", F.col("b").alias("v")), ["season", "week"], "v")
    return resample.interval(resample.block_means(both, "season", "difference", 300, 11), "mean")


@query(f"""WITH s AS ({SCORED}), b0 AS (SELECT DISTINCT lang AS block FROM s), b AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM b0),
k AS (SELECT draw, {_DRAWN.format(seed=3).replace("place", "i")} AS pick FROM b, (SELECT unnest(range(50)) AS draw)), t AS (SELECT draw, block, count(*) AS times FROM k JOIN b ON b.i = pick GROUP BY ALL),
e AS (SELECT draw, p, sum(times * quality) AS pos, sum(times * (1 - quality)) AS neg FROM s JOIN t ON block = lang GROUP BY ALL), r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY draw ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM e)
SELECT draw, round(CAST(sum(pos * (2 * under + neg)) AS DOUBLE) / nullif(CAST(2 * sum(pos) * sum(neg) AS DOUBLE), 0), 9) AS roc_auc FROM r GROUP BY draw""")
def resampled_auc(spark, sf_dir):
    d = resample.resampled_auc(scored(spark, sf_dir), "p", "quality", "lang", 50, 3)
    return d.select(F.col("draw").cast("long").alias("draw"), F.round("roc_auc", 9).alias("roc_auc"))


@query("""WITH g AS (SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 9000) AS h FROM customer GROUP BY 1), x AS (SELECT *, CAST(h AS DOUBLE) / n AS p FROM g)
SELECT segment, n, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0), 9) AS low, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 1), 9) AS high FROM x""")
def wilson_both_ends(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9000).alias("h"))
    low, high = resample.wilson(F.col("h"), F.col("n"))
    return g.select("segment", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""WITH b AS (SELECT bin, count(*) AS n, CAST(sum(quality) AS BIGINT) AS pos FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY p, doc_id) - 1) * 12 / CAST(count(*) OVER () AS DOUBLE)) AS BIGINT) AS bin FROM ({SCORED})) GROUP BY bin),
m AS (SELECT i.bin, a.bin AS a, z.bin AS z, (SELECT sum(pos) / sum(n) FROM b x WHERE x.bin BETWEEN a.bin AND z.bin) AS mean FROM b i JOIN b a ON a.bin <= i.bin JOIN b z ON z.bin >= i.bin), w AS (SELECT bin, a, min(mean) AS mean FROM m GROUP BY ALL)
SELECT b.bin, n, round(CAST(pos AS DOUBLE) / n, 9) AS rate, round((SELECT max(mean) FROM w WHERE w.bin = b.bin), 9) AS fitted FROM b""")
def isotonic_bins(spark, sf_dir):
    return resample.isotonic(scored(spark, sf_dir), "p", "quality", "doc_id", 12).select("bin", "n", F.round("rate", 9).alias("rate"), F.round("fitted", 9).alias("fitted"))


@query("""WITH h AS (SELECT c_nationkey, o_custkey, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS b, count(*) AS g FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT c_nationkey, count(a + b) AS n, CASE WHEN count(a + b) >= 3 THEN corr(a, b) END AS r, covar_samp(a, b) AS signal, var_samp(a - b) / 2 AS noise FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT c_nationkey, n, round(r, 6) AS r, round(CASE WHEN greatest(signal, 0) + noise / 4 > 0 THEN greatest(signal, 0) / (greatest(signal, 0) + noise / 4) END, 6) AS reliability FROM s""")
def signal_noise_reliability(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    half = lambda k: F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    h = o.groupBy("c_nationkey", "o_custkey").agg(half(0).alias("a"), half(1).alias("b")).dropna(subset=["a", "b"])
    signal, noise = resample.signal_noise("a", "b")
    s = h.groupBy("c_nationkey").agg(F.count("*").alias("n"), resample.pearson("a", "b").alias("r"), signal.alias("signal"), noise.alias("noise"))
    return s.select("c_nationkey", "n", F.round("r", 6).alias("r"), F.round(resample.reliability(F.col("signal"), F.col("noise"), 4), 6).alias("reliability"))


@query(f"""SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS pos, round(avg((p - quality) * (p - quality)), 9) AS brier FROM ({SCORED}) GROUP BY lang UNION ALL SELECT 'all', count(*), CAST(sum(quality) AS BIGINT), round(avg((p - quality) * (p - quality)), 9) FROM ({SCORED})""")
def metric_slices(spark, sf_dir):
    """The same metrics of every slice and of all rows, in one pass."""
    x = scored(spark, sf_dir).rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.sum("quality").cast("long").alias("pos"), F.round(metrics.brier(F.col("p"), F.col("quality")), 9).alias("brier"))
    return x.select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("lang"), "n", "pos", "brier")


@query("""SELECT * FROM (VALUES (1998, 1997, '1995,1996'), (1999, 1998, '1995,1996,1997'), (2000, 1999, '1995,1996,1997,1998'), (2001, 2000, '1995,1996,1997,1998,1999')) t(test, validation, training)""")
def fold_plan(spark, sf_dir):
    """Folds that only look back: training grows, the last season before the test one validates."""
    seasons = [r.s for r in table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("s")).distinct().collect()]  # a row a season
    plan = walkforward.plan(seasons, range(1998, 2002))
    return spark.createDataFrame([(f.test, f.validation, ",".join(map(str, f.training))) for f in plan], "test int, validation int, training string")


@query("""SELECT o_orderkey, CAST((dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate)) - 1) % 3 AS INTEGER) AS part FROM orders""")
def cross_fit_parts(spark, sf_dir):
    """Whole weeks (months here) dealt round robin."""
    o = table(spark, sf_dir, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    return walkforward.cross_fit(o, "m", 3).select("o_orderkey", "part")


@query("""WITH o AS (SELECT o_orderpriority AS week, count(*) AS n, CAST(sum(CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE o_totalprice END AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1) SELECT * FROM o""")
def store_replace_week(spark, sf_dir):
    """Two weeks of a stored table replaced whole, the rest untouched."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("week"), "o_totalprice")
    kept = store.Store(spark, scratch(spark))
    kept.replace(o)
    kept.replace(o.where("week in ('1-URGENT', '2-HIGH')").withColumn("o_totalprice", F.lit(0.0)))
    return kept.read().groupBy("week").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""WITH v AS (SELECT user_id AS model, event_type AS label, ts AS created_at, event_id AS version FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY created_at DESC) AS rn FROM v) SELECT model, label, version, created_at FROM r WHERE rn = 1""")
def current_versions(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("label"), F.col("event_id").alias("version"), F.col("ts").alias("created_at"))
    return store.current(v, ["model", "label"], "created_at", "version")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, CASE WHEN q > 25 THEN q * 2 ELSE q END AS outcome FROM o UNION ALL SELECT l_orderkey + 1000000000, l_linenumber, 0.0 FROM o WHERE q > 45""")
def write_outcomes(spark, sf_dir):
    """Outcomes by key: known keys are replaced, new ones added."""
    old = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("outcome"))
    again = old.where("outcome > 25").withColumn("outcome", F.col("outcome") * 2)
    added = old.where("outcome > 45").select((F.col("l_orderkey") + 1_000_000_000).alias("l_orderkey"), "l_linenumber", F.lit(0.0).alias("outcome"))
    return store.upserted(old, again.unionAll(added), ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place, p_retailprice AS score FROM part), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place, p_retailprice + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS score FROM part WHERE p_partkey % 97 > 0)
SELECT count(*) FILTER (WHERE b.p_partkey IS NULL) AS n_gone, count(*) FILTER (WHERE a.p_partkey IS NULL) AS n_new, round(max(abs(a.score - b.score)), 9) AS max_difference, count(*) FILTER (WHERE a.place <> b.place) AS n_moved FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def stored_against_recomputed(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("score"))
    again = p.where("p_partkey % 97 > 0").withColumn("again", F.col("score") + F.when(F.col("p_partkey") % 50 == 0, 1).otherwise(0))
    ranked = lambda df: metrics.ranked(df, [], "score", "p_partkey")
    return store.audited(ranked(p).select("p_partkey", "place", "score"), ranked(again).select("p_partkey", "place", F.col("again").alias("score")), ["p_partkey"], "place", "score")
