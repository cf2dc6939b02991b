"""Structured Streaming: totals per window of availability, late rows settled by a watermark, sinks that a retry doesn't double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.store import Store
from tidemark.sources.tables import append_snapshot


def window_totals(stream: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", late: str = "6 hours") -> DataFrame:
    """Rows and exact sums per window and key. A row later than the watermark is out; a batch frame gives the same totals."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_at", late)
    totals = timed.groupBy(F.window("_at", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return totals.select(F.col("w.start").alias("start"), *by, "n", "total")


def week_totals(stream: DataFrame, at: str, by: list[str], value: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """As window_totals, in windows (start, end]: a row at the very as_of of a week belongs to that week."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_at", late)
    shifted = timed.withColumn("_before", F.col("_at") - F.expr("interval 1 microsecond"))
    totals = shifted.groupBy(F.window("_before", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return totals.select(F.col("w.end").alias("as_of"), *by, "n", "total")


def sliding_totals(stream: DataFrame, at: str, by: list[str], value: str, width: str, step: str, late: str = "1 day") -> DataFrame:
    """Totals over windows of `width` that start every `step`."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_at", late)
    totals = timed.groupBy(F.window("_at", width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return totals.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Runs of a key's rows that follow each other within `gap`: first and last moment, rows."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_at", late)
    runs = timed.groupBy(F.session_window("_at", gap).alias("w"), *by).agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    return runs.select(*by, "first", "last", "n")


def append_snapshots(stream: DataFrame, path: str, checkpoint: str, key: str = "as_of") -> StreamingQuery:
    """Appends snapshots (values of `key`) that the table doesn't have: a batch that runs again, or a snapshot sent twice, adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        append_snapshot(batch, path, key)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guarded_upserts(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each batch's weeks replace those of the store. A batch that would change a live week fails the query and changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        store.replace(batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch to a partition named by its id: running it again replaces what it wrote."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
