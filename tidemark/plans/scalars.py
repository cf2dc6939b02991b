"""Scalar families and ordered aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import entity
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("""SELECT c_custkey, upper(c_mktsegment) AS upper_name, substr(c_name, 10, 4) AS part, split_part(c_name, '#', 2) AS number, regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1) AS digits,
 regexp_matches(c_name, '7[0-9]?$') AS has_seven, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, starts_with(c_mktsegment, 'MA') AS starts, ends_with(c_mktsegment, 'LD') AS ends,
 contains(c_mktsegment, 'UIL') AS holds, reverse(c_mktsegment) AS backward, c_mktsegment || '/' || c_nationkey AS pair, CAST(length(trim(' ' || c_name || ' ')) AS INTEGER) AS n, lower(c_mktsegment) LIKE '%u%d%' AS alike FROM customer""")
def string_family(spark, sf_dir):
    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper(segment).alias("upper_name"),
        F.substr(name, F.lit(10), F.lit(4)).alias("part"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("number"),
        F.regexp_extract(name, "#0*([1-9][0-9]*)$", 1).alias("digits"),
        name.rlike("7[0-9]?$").alias("has_seven"),
        F.lpad(nation, 3, "0").alias("padded"),
        segment.startswith("MA").alias("starts"),
        segment.endswith("LD").alias("ends"),
        segment.contains("UIL").alias("holds"),
        F.reverse(segment).alias("backward"),
        F.concat_ws("/", segment, nation).alias("pair"),
        F.char_length(F.trim(F.concat(F.lit(" "), name, F.lit(" ")))).alias("n"),
        F.lower(segment).like("%u%d%").alias("alike"),
    )


@query("""SELECT s_suppkey, abs(s_acctbal) AS size, CAST(sign(s_acctbal) AS INTEGER) AS sign, round(ln(1 + abs(s_acctbal)), 9) AS log1, round(sqrt(abs(s_acctbal)), 9) AS root, CAST(ceil(s_acctbal / 1000) AS BIGINT) AS up,
 round(log10(abs(s_acctbal) + 1), 9) AS log10, least(greatest(s_acctbal, 0), 5000) AS clipped, round(exp(-abs(s_acctbal) / 1000), 9) AS decay, isnan(CASE WHEN s_acctbal < 0 THEN 'nan'::DOUBLE ELSE s_acctbal END) AS is_nan,
 CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS filled FROM supplier""")
def math_family(spark, sf_dir):
    x = F.col("s_acctbal")
    holed = F.when(x < 0, F.lit(float("nan"))).otherwise(x)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.abs(x).alias("size"),
        F.sign(x).cast("int").alias("sign"),
        F.round(F.log1p(F.abs(x)), 9).alias("log1"),
        F.round(F.sqrt(F.abs(x)), 9).alias("root"),
        F.ceil(x / 1000).alias("up"),
        F.round(F.log10(F.abs(x) + 1), 9).alias("log10"),
        F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)).alias("clipped"),
        F.round(F.exp(-F.abs(x) / 1000), 9).alias("decay"),
        F.isnan(holed).alias("is_nan"),
        F.nanvl(holed, F.lit(0.0)).alias("filled"),
    )


@query("""SELECT event_id, CAST(month(ts) AS INTEGER) AS m, make_timestamp(year(ts), month(ts), 1, 10, 30, 0) AS made, CAST(strptime(strftime(ts, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS TIMESTAMP) AS parsed,
 timezone('Europe/Paris', timezone('UTC', ts)) AS in_paris, CAST(date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS INTEGER) AS days, epoch_us(ts) AS us, ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00' AS inside FROM events""")
def time_family(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.month(ts).alias("m"),
        F.make_timestamp_ntz(F.year(ts), F.month(ts), F.lit(1), F.lit(10), F.lit(30), F.lit(0)).alias("made"),
        F.to_timestamp_ntz(F.date_format(ts, "dd/MM/yyyy HH:mm"), F.lit("dd/MM/yyyy HH:mm")).alias("parsed"),
        F.convert_timezone(F.lit("UTC"), F.lit("Europe/Paris"), ts).alias("in_paris"),
        F.date_diff(F.to_date(ts), F.lit("2023-12-25").cast("date")).alias("days"),
        F.unix_micros(ts.cast("timestamp")).alias("us"),
        ts.between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09 12:00:00").cast("timestamp_ntz")).alias("inside"),
    )


@query("""SELECT o_orderkey, list_max([a, b, c]) AS best, CAST(list_position([a, b, c], list_max([a, b, c])) AS INTEGER) AS place, CAST(len(list_filter([a, b, c], lambda x: x > 2)) AS INTEGER) AS n_large, list_contains([a, b, c], 0) AS has_zero,
 [a, b, c][1] AS first, array_to_string([a, b, c], '-') AS joined, a > 0 AND b > 0 AND c > 0 AS all_set, a = 6 OR b = 6 OR c = 6 AS any_six, string_split(o_orderpriority, '-')[2] AS word
FROM (SELECT o_orderkey, o_orderpriority, o_orderkey % 7 AS a, o_custkey % 7 AS b, (o_orderkey + o_custkey) % 7 AS c FROM orders)""")
def list_family(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    xs = o.select("o_orderkey", "o_orderpriority", F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 7, (F.col("o_orderkey") + F.col("o_custkey")) % 7).alias("xs"))
    v = F.col("xs")
    return xs.select(
        "o_orderkey",
        F.array_max(v).alias("best"),
        F.array_position(v, F.array_max(v)).cast("int").alias("place"),
        F.size(F.filter(v, lambda x: x > 2)).alias("n_large"),
        F.array_contains(v, 0).alias("has_zero"),
        F.get(v, F.lit(0)).alias("first"),
        F.array_join(F.transform(v, lambda x: x.cast("string")), "-").alias("joined"),
        F.forall(v, lambda x: x > 0).alias("all_set"),
        F.exists(v, lambda x: x == 6).alias("any_six"),
        F.get(F.split("o_orderpriority", "-"), F.lit(1)).alias("word"),
    )


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, bool_or(o_orderstatus = 'P') AS any_open, bool_and(o_orderstatus <> 'P') AS none_open,
 string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderdate DESC, o_orderkey) AS history, min(o_totalprice) AS low FROM orders GROUP BY o_custkey""")
def ordered_aggregates(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), key.alias("k"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct(price, -key)).alias("dearest"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"),
        F.bool_and(F.col("o_orderstatus") != "P").alias("none_open"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"),
        F.array_join(F.transform(newest, lambda x: x["k"].cast("string")), " ").alias("history"),
        F.min("o_totalprice").alias("low"),
    )


@query("""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, min(l_quantity) AS mode FROM c WHERE n = (SELECT max(n) FROM c x WHERE x.l_suppkey = c.l_suppkey) GROUP BY 1)
SELECT l.l_suppkey, any_value(mode) AS mode, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov,
 count(DISTINCT (l_partkey, l_returnflag)) AS n_pairs, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (WHERE l_tax > 0.04) AS n_taxed FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey GROUP BY l.l_suppkey""")
def spread_aggregates(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.mode("l_quantity", True).alias("mode"),
        F.round(F.avg(q), 9).alias("mean"),
        F.round(F.stddev_samp(q), 6).alias("sd"),
        F.round(F.var_samp(q), 6).alias("var"),
        F.round(F.covar_samp(q, F.col("l_extendedprice")), 3).alias("cov"),
        F.count_distinct("l_partkey", "l_returnflag").alias("n_pairs"),
        F.count_distinct("l_partkey").alias("n_parts"),
        F.count_if(F.col("l_tax") > 0.04).alias("n_taxed"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(to_json({'user': user_id, 'kind': event_type}) AS VARCHAR) AS packed FROM events""")
def json_family(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))).alias("packed"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' WHEN '3-MEDIUM' THEN 'c' WHEN '4-NOT SPECIFIED' THEN 'd' WHEN '5-LOW' THEN 'e' ELSE error('unknown') END AS grade,
 TRY_CAST(substr(o_orderpriority, 1, 2) AS INTEGER) IS NULL AS not_a_number, md5(o_orderpriority || o_orderkey) AS h, o_orderstatus IN ('F', 'O') AS closed, o_orderstatus NOT IN ('F', 'O') AS open FROM orders""")
def strict_mapping(spark, sf_dir):
    """A value that the mapping lacks is an error, never a null."""
    grades = {"1-URGENT": "a", "2-HIGH": "b", "3-MEDIUM": "c", "4-NOT SPECIFIED": "d", "5-LOW": "e"}
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        entity.strict(p, grades).alias("grade"),
        F.substr(p, F.lit(1), F.lit(2)).try_cast("int").isNull().alias("not_a_number"),
        F.md5(F.concat(p, F.col("o_orderkey").cast("string"))).alias("h"),
        F.col("o_orderstatus").isin("F", "O").alias("closed"),
        (~F.col("o_orderstatus").isin("F", "O")).alias("open"),
    )


@query("""SELECT event_id, max(value) OVER w AS highest, min(value) OVER w AS lowest, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS quarter, percent_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pr,
 cume_dist() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cd, nth_value(value, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_extremes(spark, sf_dir):
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.max("value").over(w).alias("highest"),
        F.min("value").over(w).alias("lowest"),
        F.ntile(4).over(o).alias("quarter"),
        F.percent_rank().over(o).alias("pr"),
        F.cume_dist().over(o).alias("cd"),
        F.nth_value("value", 3).over(w).alias("third"),
    )


@query("""SELECT user_id, round(avg(value), 9) AS tail_mean, count(*) AS n, any_value(last_value) AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
 last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value FROM events) WHERE back <= 5 GROUP BY user_id""")
def tail_mean(spark, sf_dir):
    """The mean of the last five rows of each entity, and the very last."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    tail = table(spark, sf_dir, "events").withColumn("back", back).where("back <= 5")
    return tail.groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("tail_mean"), F.count("*").alias("n"), F.max(F.when(F.col("back") == 1, F.col("value"))).alias("last_value"))


@query("""WITH RECURSIVE r(n, lo, hi) AS (SELECT 0, CAST(min(l_quantity) AS DOUBLE), CAST(max(l_quantity) AS DOUBLE) FROM lineitem UNION ALL SELECT n + 1, lo + (hi - lo) / 4, hi - (hi - lo) / 4 FROM r WHERE n < 5) SELECT CAST(n AS INTEGER) AS n, lo, hi FROM r""")
def recursive_halving(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tidemark_recursion")
    return spark.sql("""WITH RECURSIVE r(n, lo, hi) AS (SELECT 0, min(l_quantity), max(l_quantity) FROM tidemark_recursion
        UNION ALL SELECT n + 1, lo + (hi - lo) / 4, hi - (hi - lo) / 4 FROM r WHERE n < 5) SELECT * FROM r""")


@query("""SELECT n_nationkey, strip_accents(lower('Ñandú É' || n_name)) AS name, n_name LIKE 'NATION__' AS short FROM nation""")
def accent_strip(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", entity.without_accents(F.lower(F.concat(F.lit("Ñandú É"), "n_name"))).alias("name"), F.col("n_name").like("NATION__").alias("short"))
