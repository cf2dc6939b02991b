"""Availability rules: when each row of a table became public, compiled to one projection over left joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """Times of another table: joined by `on` (column here: column there), which must be unique there."""

    table: DataFrame
    on: dict[str, str]
    columns: tuple[str, ...]

    def joined(self, df: DataFrame) -> DataFrame:
        keys = list(self.on.values())
        other = self.table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *self.columns)
        same = reduce(lambda a, b: a & b, [df[here] == other[f"_k{i}"] for i, here in enumerate(self.on)])
        return df.join(other, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])

    def repeated(self) -> DataFrame:
        """Keys that would multiply rows; empty if the rule is sound."""
        return self.table.groupBy(*self.on.values()).count().where("count > 1")


@dataclass(frozen=True)
class Branch:
    """Rows that `when` holds for, and no branch before, are public from `at`."""

    name: str
    when: Column
    at: Column


@dataclass(frozen=True)
class Rules:
    branches: tuple[Branch, ...]
    joins: tuple[Lookup, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        """df with available_at and branch; the joined columns don't stay. A row that no branch takes has null in both."""
        out = reduce(lambda d, j: j.joined(d), self.joins, df)
        at, name = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
        for b in reversed(self.branches):
            held = F.coalesce(b.when, F.lit(False))
            at, name = F.when(held, b.at.cast("timestamp_ntz")).otherwise(at), F.when(held, b.name).otherwise(name)
        return out.select(*df.columns, at.alias("available_at"), name.alias("branch"))


def account(df: DataFrame) -> DataFrame:
    """Rows, times and nulls by branch."""
    at = F.col("available_at")
    return df.groupBy("branch").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_if(at.isNull()).alias("n_null"))


def complete(df: DataFrame) -> DataFrame:
    """df, if every row has a time; otherwise an error that names the branches."""
    bad = [r.branch for r in account(df).where("n_null > 0").select("branch").collect()]  # a row a branch
    if bad:
        raise ValueError(f"rows without availability: {bad}")
    return df


def visible_from(df: DataFrame, key: str, known: Column, traces: Sequence[DataFrame], trace_key: str, at: str) -> DataFrame:
    """df with available_at: `known`, or else the first time that any of the event tables mentions the row's key. Each table is reduced to one time a key before they meet."""
    firsts = [t.groupBy(F.col(trace_key).alias("_k")).agg(F.min(at).alias("_at")) for t in traces]
    first = reduce(lambda a, b: a.unionByName(b), firsts).groupBy("_k").agg(F.min("_at").alias("_at"))
    return df.join(first, F.col(key) == F.col("_k"), "left").withColumn("available_at", F.coalesce(known, F.col("_at"))).drop("_k", "_at")
