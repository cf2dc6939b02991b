"""Ties, nulls, boundaries and guards that the queries don't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs, metrics, resample
from tidemark.operators import asof, entity, joins, model, store, walkforward, windows
from tidemark.sources import tables
from tidemark.streaming import live


def at(h):
    return dt.datetime(2024, 1, 1, h)


def test_moment_reads_dates_zones_and_texts():
    assert asof.moment("2024-01-02") == dt.datetime(2024, 1, 2, 23, 59, 59, 999999)
    assert asof.moment("2024-01-02T03:00:00+02:00") == dt.datetime(2024, 1, 2, 1)
    assert asof.moment(dt.date(2024, 1, 2)) == asof.moment("2024-01-02")


AT2 = dt.datetime(2024, 1, 1, 2, tzinfo=dt.UTC)


def events(spark):
    return spark.createDataFrame([(1, at(1), 1.0), (2, at(2), 2.0), (3, at(3), 3.0)], "id int, available_at timestamp_ntz, v double")


def test_a_row_is_known_at_its_own_moment_and_an_outcome_after(spark):
    e = events(spark)
    assert {r.id for r in asof.known(e, AT2).collect()} == {1, 2}
    assert {r.id for r in asof.outcomes(e, AT2, AT2 + dt.timedelta(hours=1)).collect()} == {3}


def test_session_shows_views_only_and_refuses_tables_without_a_rule(spark):
    load = {"e": lambda s: events(s), "m": lambda s: events(s)}
    session = asof.AsOfSession(spark, load, {"e": asof.Rule("event", masks={"v": "available_at + interval 1 hour"}), "m": asof.Rule("meta")}, AT2)
    assert [(r.id, r.v) for r in session.sql("select id, v from e order by id").collect()] == [(1, 1.0), (2, None)]
    assert "m" not in session.views and not spark.catalog.tableExists("e")
    with pytest.raises(ValueError):
        asof.AsOfSession(spark, load, {"e": asof.Rule("static")}, AT2)


def test_moments_must_say_their_zone():
    for bad in (dt.datetime(2024, 1, 1), "2024-01-01T00:00:00"):
        with pytest.raises(TypeError):
            asof.moment(bad)
    with pytest.raises(TypeError):
        asof.moment(5)
    assert asof.parse("2024-W7") == (2024, 7) and asof.parse(" 2024-01-01T00:00:00Z ") == dt.datetime(2024, 1, 1)
    for bad in ("2024-W", "yesterday", "2024-01-01T00:00:00"):
        with pytest.raises((ValueError, TypeError)):
            asof.parse(bad)
    assert asof.mentioned("select * from Orders o join \"nation\"", ["orders", "nation", "order"]) == ["nation", "orders"]


def test_what_can_not_decide_availability_is_refused(spark):
    e = events(spark)
    with pytest.raises(ValueError, match="no column"):
        asof.known(e.drop("available_at"), AT2)
    with pytest.raises(TypeError, match="not a moment"):
        asof.known(e.withColumn("available_at", F.lit("2024")), AT2)
    with pytest.raises(ValueError, match="null"):
        asof.known(e.withColumn("available_at", F.when(F.col("id") > 1, F.col("available_at"))), AT2)
    with pytest.raises(ValueError, match="joined"):
        asof.outcomes(e.withColumn("available_at_right", F.col("available_at")), AT2)


def test_leaks_are_found(spark):
    secret = spark.createDataFrame([(1, at(1), at(1), "a", True, dt.date(2024, 1, 1)), (2, at(1), at(3), "b", False, dt.date(2024, 1, 2)), (3, None, at(1), "c", None, None)], "id int, available_at timestamp_ntz, later timestamp_ntz, s string, b boolean, d date")
    tables = {"e": events(spark), "m": secret, "h": secret}
    rules = {"e": asof.Rule("event"), "m": asof.Rule("event", masks={"s": "later", "b": "later"}), "h": asof.Rule("hindsight", allowed=("id", "available_at"))}
    leaks = lambda build: {r.variant for r in asof.invariant(build, tables, rules, AT2).collect()}
    assert leaks(lambda w: w.view("e").agg(F.sum("v"))) == set()
    assert leaks(lambda w: w.view("m").select("id", "s", "b", "d").unionAll(w.view("h").select("id", F.lit(""), F.lit(True), F.current_date()))) == set()
    assert leaks(lambda w: w.raw("e").agg(F.max("v"))) == {"deleted", "scrambled"}
    assert leaks(lambda w: asof.known(w.raw("m"), AT2, check=False).select("s")) == {"scrambled"}
    assert leaks(lambda w: asof.known(w.raw("m"), AT2, check=False).select("b")) == {"scrambled"}
    assert leaks(lambda w: w.raw("h").where("id = 1").select("d")) == {"scrambled"}
    assert leaks(lambda w: w.raw("h").select("id")) == {"deleted", "scrambled"}  # a row without a moment isn't public
    with pytest.raises(ValueError):
        asof.World(tables, {"e": asof.Rule("meta")}, AT2).view("e")


def test_every_type_is_scrambled(spark):
    x = spark.sql("select 1 i, 2L l, 1.5D d, 1.25BD c, true b, 'ab' s, timestamp_ntz'2024-01-01' t, date'2024-01-01' e, cast(null as string) n")
    y = x.select(*[asof.scrambled(F.col(c), k).alias(c) for c, k in x.dtypes])
    assert all(a != b for a, b in zip(x.first(), y.first(), strict=True)) and [k for _, k in y.dtypes][:6] == [k for _, k in x.dtypes][:6]


def test_difference_names_what_differs(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (None, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (None, 4.0, "q"), (5, 1.0, "w")], "k int, v double, s string")
    assert {(r.k, r.what) for r in asof.difference(a, b, ["k"]).collect()} == {(2, "missing"), (None, "v,s"), (5, "new")}


def test_asof_join_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", at(2), 1), ("a", at(5), 2), ("b", at(1), 3), (None, at(9), 4)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(2), 10.0), ("a", at(2), 11.0), ("a", at(4), 20.0), ("b", at(2), 30.0)], "k string, t timestamp_ntz, v double")
    got = {r.id: r.prior_v for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {1: 11.0, 2: 20.0, 3: None, 4: None}
    strict = {r.id: r.prior_v for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"], strict=True).collect()}
    assert strict == {1: None, 2: 20.0, 3: None, 4: None}


def test_interval_join_is_open_below_and_closed_above(spark):
    points = spark.createDataFrame([(h, at(h)) for h in range(1, 6)], "p int, t timestamp_ntz")
    spans = spark.createDataFrame([("x", at(1), at(3)), ("y", at(3), at(4))], "s string, a timestamp_ntz, b timestamp_ntz")
    assert sorted((r.p, r.s) for r in joins.interval_join(points, "t", spans, "a", "b", 3600).collect()) == [(2, "x"), (3, "x"), (4, "y")]


def test_null_keys_are_equal_in_null_safe_joins_and_islands(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, b string")
    assert [(r.a, r.b) for r in joins.null_safe(a, b, ["k"]).collect()] == [("y", "z")]
    runs = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None)], "u int, o int, v string")
    assert [r.island for r in windows.islands(runs, ["u"], ["o"], "v").orderBy("o").collect()] == [1, 1, 2, 3]


def test_specs_type_project_and_deduplicate(spark):
    spec = model.Table("t", (model.Field("k", "bigint", "id"), model.Field("n", "int"), model.Field("s", "string"), model.Field("twice", "double", derived="n * 2"), model.Field("lost", "date")), ("k",), ("n desc", "s"), ("k",))
    raw = spark.createDataFrame([(1, "5", ""), (1, "7", "b"), (1, "7", "a"), (None, "1", "q")], "id int, n string, s string")
    assert [tuple(r) for r in spec.build(raw).collect()] == [(1, 7, "a", 14.0, None)]
    assert model.drift(raw, spec) == {"missing": ["lost"], "added": [], "retyped": ["id", "n"]}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spec.build(spark.createDataFrame([(1, "x", "")], "id int, n string, s string")).collect()
    audit = model.key_audit(raw, ["id"]).first()
    assert tuple(audit) == (4, 2, 1, 1)
    assert model.content_hash(raw).first() == model.content_hash(raw.orderBy("n").repartition(3)).first()


def test_scores_count_null_as_unknown(spark):
    x = spark.createDataFrame([(None, 2.0), (40.0, None), (20.0, 0.0)], "a double, b double")
    got = x.select(exprs.linear_score({"a": 1, "b": 2}), exprs.tier_score(F.col("a"), [(20, 1), (40, 2)], 0), exprs.flag(F.col("a") > 30), exprs.ratio(F.col("a"), F.col("b")), exprs.horizontal_mean(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(4.0, None, False, None, 2.0), (40.0, 2.0, True, None, 40.0), (20.0, 1.0, False, None, 10.0)]


def test_areas_settle_ties_by_halves(spark):
    x = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, y int")
    assert metrics.roc_auc(x, "p", "y").first()[0] == 0.875
    assert metrics.roc_auc(x.where("y = 1"), "p", "y").first()[0] is None
    assert [r.n for r in metrics.calibration(x, "p", "y", 4).orderBy("bin").collect()] == [1, 0, 2, 1]


def test_bootstrap_is_the_same_on_every_run(spark):
    x = spark.createDataFrame([(k % 30, k % 2) for k in range(300)], "b int, y int")
    one = sorted(resample.block_means(x, "b", "y", 100, 3).collect())
    assert len(one) == 100 and one == sorted(resample.block_means(x.repartition(5), "b", "y", 100, 3).collect())
    times = resample.index_table(x.select("b").distinct(), "b", 50, 1).groupBy("draw").agg(F.sum("times").alias("n")).collect()
    assert {r.n for r in times} == {30}
    with pytest.raises(ValueError, match="different groups"):
        resample.paired(x.select("b", "y").limit(3), x.select("b", "y").limit(2), ["b"], "y")


def test_folds_look_back(spark):
    assert walkforward.plan([2001, 2002, 2003, 2004], [2004, 2003]) == [walkforward.Fold(2003, 2002, (2001,)), walkforward.Fold(2004, 2003, (2001, 2002))]
    with pytest.raises(ValueError):
        walkforward.plan([2003, 2004], [2004])
    rows = spark.createDataFrame([(2001,), (2003,)], "season int")
    with pytest.raises(ValueError, match="2003"):
        walkforward.before(rows, "season", 2003)
    assert walkforward.before(rows, "season", 2004).count() == 2


def test_versions_have_one_current_and_content_ids(spark):
    assert store.version_of(a=1, b="x") == store.version_of(b="x", a=1) != store.version_of(a=2, b="x")
    v = spark.createDataFrame([("m", 1, "v1"), ("m", 2, "v2"), ("n", 1, "v3")], "model string, t int, version string")
    assert sorted(map(tuple, store.current(v, ["model"], "t", "version").collect())) == [("m", "v2", 2), ("n", "v3", 1)]
    with pytest.raises(Exception, match="versions of one moment"):
        store.current(v.unionByName(v.withColumn("version", F.lit("w"))), ["model"], "t", "version").collect()
    again = store.registered(v, spark.createDataFrame([("m", 9, "v1"), ("q", 1, "v9")], v.schema), "version", "t")
    assert sorted(map(tuple, again.collect())) == [("m", 2, "v2"), ("m", 9, "v1"), ("n", 1, "v3"), ("q", 1, "v9")]


def test_names_ids_and_bridges(spark):
    x = spark.createDataFrame([(" 12.0 ", "Bob  O'Neil Jr."), ("nan", "AL x III"), ("007", ""), ("v1.0", "José Núñez V"), ("1.50", "A.J. St-Brown"), ("", None)], "i string, n string")
    got = [tuple(r) for r in x.select(entity.canonical(F.col("i")), entity.name_key(F.col("n"))).collect()]
    assert got == [("12", "bob oneil"), (None, "al x"), ("007", ""), ("v1.0", "jose nunez"), ("1.50", "aj st brown"), (None, None)]
    with pytest.raises(Exception, match="not in the mapping"):
        x.select(entity.strict(F.col("i"), {"nan": "b"})).collect()
    c = spark.createDataFrame([("t", 1, "a", 0), ("t", 1, "b", 1), ("t", 2, "a", 0), ("t", 2, "b", 0)], "id_type string, source_id int, e string, pr int")
    assert sorted(map(tuple, entity.bridge(c, "id_type", "source_id", "e", "pr").collect())) == [("t", 1, "a", 1), ("t", 2, None, 2)]


def test_store_replaces_weeks_but_never_a_live_one(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/p")
    rows = lambda w, v: spark.createDataFrame([(w, v)], "week int, v int")
    s.replace(rows(1, 10))
    s.replace(rows(2, 20), live=True)
    s.replace(rows(1, 11))
    assert sorted((r.week, r.v) for r in s.read().collect()) == [(1, 11), (2, 20)]
    with pytest.raises(ValueError):
        s.replace(rows(2, 21))


def test_sources_read_under_declared_schemas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,\n")
    schema = tables.T.StructType.fromDDL("k int, v string")
    assert [tuple(r) for r in tables.read(spark, f"{tmp_path}/a.csv", "csv", schema).collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        tables.read(spark, f"{tmp_path}/a.csv", "csv")
    tables.write(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/p1")
    tables.write(spark.createDataFrame([(3, 4)], "a int, c int"), f"{tmp_path}/p2")
    both = tables.read(spark, [f"{tmp_path}/p1", f"{tmp_path}/p2"], with_file=True)
    assert {(r.a, r.b, r.c) for r in both.collect()} == {(1, 2, None), (3, None, 4)} and both.select("_file").distinct().count() == 2
    assert tables.snapshot(both.drop("_file")) == '{"a": "int", "b": "int", "c": "int"}'


def test_stream_totals_equal_the_batch_and_batches_replace_themselves(spark, tmp_path):
    e = spark.createDataFrame([(k, at(k % 20), "a" if k % 3 else "b", k / 4) for k in range(100)], "id int, ts timestamp_ntz, kind string, value double")
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = live.window_totals(stream, "ts", ["kind"], "value", "6 hours").writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(spark.table("totals").collect()) == sorted(live.window_totals(e, "ts", ["kind"], "value", "6 hours").collect())
    live.replace_batches(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(90)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
