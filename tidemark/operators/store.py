"""Predictions that are kept, replaced by week, and compared with what is computed again."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A table partitioned by week under one folder. A week's rows are replaced whole; a live week can't be replaced."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def replace(self, rows: DataFrame, live: bool = False) -> None:
        rows = rows.withColumn("live", F.lit(live))
        if not live and self._exists():
            kept = self.read().where("live").select("week").distinct()
            clash = rows.select("week").distinct().join(kept, "week").limit(1).collect()
            if clash:
                raise ValueError(f"week {clash[0].week} is a live record")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(self.path)

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)


def merged(old: DataFrame, new: DataFrame, week: str) -> DataFrame:
    """old with the weeks that new has replaced by new's rows."""
    return old.join(new.select(week).distinct(), week, "left_anti").unionByName(new)


def compared(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of either list with what became of them: same, moved, gone, new."""
    a, b = old.select(*key, F.col(value).alias("old")), new.select(*key, F.col(value).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "same").otherwise("moved")
    return a.join(b, key, "full").withColumn("state", state)


def current(versions: DataFrame, by: list[str], created: str, version: str) -> DataFrame:
    """The newest version of each group. Two versions made at one moment are an error: which of them holds is not known."""
    newest = versions.groupBy(*by).agg(F.max(created).alias(created))
    held = versions.join(newest, [*by, created]).groupBy(*by, created).agg(F.min(version).alias(version), F.count("*").alias("_n"))
    tie = F.raise_error(F.concat(F.lit("versions of one moment: "), F.col(version).cast("string"))).cast(versions.schema[version].dataType)
    return held.select(*by, F.when(F.col("_n") == 1, F.col(version)).otherwise(tie).alias(version), created)


def registered(versions: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """versions with new ones added; one that is there already only gets the later time."""
    return versions.unionByName(new).groupBy(*[c for c in versions.columns if c != created]).agg(F.max(created).alias(created)).select(*versions.columns)


def version_of(**parts) -> str:
    """A content-addressed id: the same parts give the same id, whatever their order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key, and new keys added. Null keys are equal."""
    k = new.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return old.join(k, same, "left_anti").unionByName(new)


def audited(stored: DataFrame, again: DataFrame, key: list[str], place: str, number: str) -> DataFrame:
    """One row: keys that only one side has, the largest difference of the number, keys at another place."""
    a, b = stored.select(*key, F.col(place).alias("_p"), F.col(number).alias("_x")), again.select(*key, F.col(place).alias("_q"), F.col(number).alias("_y"))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("_q").isNull()).alias("n_gone"), F.count_if(F.col("_p").isNull()).alias("n_new"), F.round(F.max(F.abs(F.col("_x") - F.col("_y"))), 9).alias("max_difference"), F.count_if(F.col("_p") != F.col("_q")).alias("n_moved"))
