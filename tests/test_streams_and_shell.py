"""Streams: bounds, late rows, sessions, retries, guards; and the command line."""

import datetime as dt
import time

import pytest

from tidemark import __main__ as shell
from tidemark.operators import store
from tidemark.streaming import live


def at(h, m=0):
    return dt.datetime(2024, 1, 1 + h // 24, h % 24, m)


def stream_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def finished(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


EVENTS = "id int, ts timestamp_ntz, k string, v double"


def test_windows_hold_their_end(spark):
    x = spark.createDataFrame([(1, at(24), "a", 1.0), (2, at(24, 1), "a", 2.0), (3, at(1), "a", 4.0)], EVENTS)
    assert sorted((r.as_of, r.total) for r in live.week_totals(x, "ts", ["k"], "v", "1 day").collect()) == [(at(24), 5.0), (at(48), 2.0)]
    assert sorted((r.start, r.n) for r in live.sliding_totals(x, "ts", ["k"], "v", "2 days", "1 day").collect()) == [(at(0) - dt.timedelta(days=1), 1), (at(0), 3), (at(24), 2)]
    runs = live.sessions(spark.createDataFrame([(k, at(h), "a", 0.0) for k, h in enumerate((0, 1, 2, 9, 10))], EVENTS), "ts", ["k"], "3 hours")
    assert sorted((r.first, r.last, r.n) for r in runs.collect()) == [(at(0), at(2), 3), (at(9), at(10), 2)]


def test_rows_later_than_the_watermark_are_out(spark, tmp_path):
    path = f"{tmp_path}/in"
    stream = stream_of(spark, path, [(1, at(0, 10), "a", 1.0), (2, at(40), "a", 1.0)], EVENTS).repartition(1)
    totals = live.window_totals(stream, "ts", ["k"], "v", "1 hour", "2 hours")
    q = totals.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    time.sleep(0.1)
    stream_of(spark, path, [(3, at(0, 20), "a", 100.0), (4, at(90), "a", 1.0)], EVENTS)  # the first is two days late
    q = totals.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(at(0), 1, 1.0), (at(40), 1, 1.0)}


def test_snapshots_and_weeks_survive_retries(spark, tmp_path):
    schema = "as_of int, week int, v int"
    stream = stream_of(spark, f"{tmp_path}/s", [(1, 1, 10), (2, 1, 11)], schema)
    for k in range(2):  # the second run has lost its checkpoint and sees all rows again
        live.append_snapshots(stream, f"file://{tmp_path}/snap", f"{tmp_path}/c{k}").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 2
    kept = store.Store(spark, f"file://{tmp_path}/store")
    live.guarded_upserts(stream, kept, f"{tmp_path}/g1").awaitTermination(120)
    assert kept.read().count() == 2
    kept.replace(spark.createDataFrame([(3, 1, 99)], schema), live=True)
    with pytest.raises(Exception, match="live record"):
        live.guarded_upserts(stream, kept, f"{tmp_path}/g2").awaitTermination(120)
    assert [r.v for r in kept.read().collect()] == [99]


def test_shell(spark, capsys, tmp_path):
    data = "/root/testdata/sf0.001"
    assert shell.main(["version"]) == 0 and shell.main(["queries"]) == 0
    assert "asof_orders_by_nation (SQL)" in capsys.readouterr().out
    assert shell.main(["run", "fold_plan", "--data", data, "--format", "csv"]) == 0
    assert capsys.readouterr().out.startswith("test,validation,training\n1998,1997")
    assert shell.main(["asof", "1998-01-01", "select count(*) n, max(o_orderdate) < '1998-01-01' ok from orders", "--data", data, "--format", "csv"]) == 0
    assert ",true" in capsys.readouterr().out.lower()
    assert shell.main(["audit", "nation", "n_nationkey", "--data", data]) == 0 and "| 25 | 25 | 0 | 0 |" in capsys.readouterr().out
    assert shell.main(["run", "score_breakdown", "--data", data]) == 1 and "over 100 rows" in capsys.readouterr().err
    assert shell.main(["weeks", "orders", "o_orderdate", "--data", data, "--rows", "1000"]) == 0
    assert shell.main(["export", "fold_plan", f"file://{tmp_path}/plan", "--data", data]) == 0 and spark.read.parquet(f"{tmp_path}/plan").count() == 4
