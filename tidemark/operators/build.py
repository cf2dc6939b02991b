"""Building tables: typed casts, normalised codes, materialisation with account, assertions, corrections, manifests, atomic versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import model, windows

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def strict_cast(df: DataFrame, column: str, target: str, zone: str = "UTC") -> Column:
    """column as target. A fraction never becomes a whole number in silence, text that doesn't parse is an error, empty text is null, and a
    moment with a zone becomes UTC without one."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(column)
    if target in _WHOLE and kind in ("double", "float"):
        bad = F.raise_error(F.concat(F.lit(f"{column}: not a whole number: "), c.cast("string"))).cast(target)
        return F.when(c.isNull() | F.isnan(c), F.lit(None).cast(target)).when(c == F.floor(c), c.cast(target)).otherwise(bad)
    if kind == "string":
        c = F.when(F.trim(c) != "", F.trim(c))
    if target == "timestamp_ntz" and kind == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz"))
    return c.cast(target)


def normalized(c: Column, aliases: Mapping[str, str]) -> Column:
    """A code: empty is null, an alias is its present form."""
    t = F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(*[F.when(t == old, new) for old, new in aliases.items()], t)


def priority(c: Column, order: Sequence[str]) -> Column:
    """Place of a status in an order of preference; what it doesn't name comes last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(order) + 1).cast("int")


def height_inches(c: Column) -> Column:
    """'feet-inches' as inches if the whole text is that, else null."""
    part = lambda k: F.split_part(c, F.lit("-"), F.lit(k)).try_cast("int")
    return F.when(c.rlike(r"^[0-9]+-[0-9]+$"), part(1) * 12 + part(2))


def slug(c: Column) -> Column:
    """A key from a name: lower case words joined by '-'."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def materialized(stage: DataFrame, key: list[str], order: list[Column], not_null: list[str], distinct: bool = False) -> tuple[DataFrame, Observation]:
    """The table of a stage, one row a key by a total order, rows without a needed column dropped; the observation counts rows before and after that when the table is written, without another scan."""
    seen = Observation(f"tidemark-{uuid.uuid4().hex}")
    out = stage.distinct() if distinct else stage
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in not_null], F.lit(True))
    out = out.observe(seen, F.count("*").alias("staged"), F.count_if(~whole).alias("without_key"))
    return windows.first_of(out.where(whole), key, order), seen


def accounted(stage: DataFrame, key: list[str], not_null: list[str]) -> DataFrame:
    """One row: staged rows, rows without a needed column, rows that repeat a key, rows kept. One aggregation by key."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in not_null], F.lit(True))
    per = stage.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(whole).alias("m"))
    return per.agg(F.sum("n").alias("staged"), F.sum(F.col("n") - F.col("m")).alias("without_key"), F.sum(F.greatest(F.col("m") - 1, F.lit(0))).alias("repeated"), F.count_if(F.col("m") > 0).alias("kept"))


def assert_key(df: DataFrame, key: list[str], required: list[str] | None = None) -> DataFrame:
    """df, if no key repeats (nulls are equal) and no required column is null; otherwise an error with the counts."""
    audit = model.key_audit(df, key).first()
    if audit.n_repeated:
        raise ValueError(f"{audit.n_repeated} keys of {key} repeat")
    for c in required if required is not None else key:
        if not df.where(F.col(c).isNull()).limit(1).isEmpty():
            raise ValueError(f"{c} is null in some rows")
    return df


def corrected(df: DataFrame, corrections: DataFrame, key: list[str], at: str, column: str) -> DataFrame:
    """df with `column` replaced where a correction (key, first, last, value) covers `at`, and `is_corrected`. Corrections that overlap on one key are an error."""
    w = Window.partitionBy(*key).orderBy("first")
    clash = corrections.withColumn("_next", F.lead("first").over(w)).where(F.col("_next") <= F.col("last"))
    if not clash.limit(1).isEmpty():
        raise ValueError(f"corrections overlap: {clash.first()}")
    c = corrections.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("value").alias("_value"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key]) & F.col(at).between(F.col("_first"), F.col("_last"))
    out = df.join(c, same, "left")
    return out.withColumns({"is_corrected": F.col("_first").isNotNull(), column: F.coalesce("_value", column)}).drop("_first", "_last", "_value", *[f"_{k}" for k in key])


def relaxed_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; a column that some lack is null there, one of several types has the widest (whole < double < text)."""
    rank = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}
    kinds: dict[str, str] = {}
    for f in frames:
        for c, k in f.dtypes:
            old = kinds.get(c, k)
            kinds[c] = k if old == k else max(old, k, key=lambda x: rank[x]) if old in rank and k in rank else "string"
    cast = [f.select(*[F.col(c).cast(kinds[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def enriched(facts: DataFrame, dimension: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """facts with columns of a dimension that has one row a key."""
    return facts.join(dimension.select(*on, *columns), on, "left")


def disagreeing(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """One row: rows, and for each pair of columns that should agree, how many don't (two nulls do)."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"n_{a}") for a, b in pairs.items()])


def with_opponent(rows: DataFrame, game: list[str], team: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows of two sides a game, each with columns of the other side: {column there: name here}. One window over a game, no self join."""
    other = F.filter(F.collect_list(F.struct(F.col(team).alias("_t"), *columns)).over(Window.partitionBy(*game)), lambda x: x["_t"] != F.col(team))
    out = rows.withColumn("_o", F.get(other, F.lit(0)))
    return out.select(*rows.columns, *[F.col(f"_o.{c}").alias(n) for c, n in columns.items()])


def sole_link(rows: DataFrame, links: DataFrame, on: list[str], target: str, fits: Column) -> DataFrame:
    """rows with `target` of the link alike in all of `on` (nulls are equal), if exactly one of the links there fits the row; otherwise null."""
    r = rows.withColumn("_id", F.monotonically_increasing_id())
    named = links.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in links.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    met = r.join(named, same, "left").groupBy("_id", *rows.columns).agg(F.count_if(fits).alias("_n"), F.min(F.when(fits, F.col(target))).alias(target))
    return met.select(*rows.columns, F.when(F.col("_n") == 1, F.col(target)).alias(target))


def manifest(tables: Mapping[str, DataFrame], season: Mapping[str, str], notes: Mapping[str, dict]) -> DataFrame:
    """One row a table: rows, content hash, first and last season, notes as JSON."""
    out = None
    for name, df in tables.items():
        s = F.col(season[name]) if name in season else F.lit(None).cast("int")
        text = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
        row = df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*text).cast("decimal(38,0)")).cast("string").alias("hash"), F.min(s).alias("first_season"), F.max(s).alias("last_season"))
        row = row.select(F.lit(name).alias("name"), "n_rows", "hash", "first_season", "last_season", F.lit(json.dumps(notes.get(name, {}), sort_keys=True)).alias("notes"))
        out = row if out is None else out.unionByName(row)
    return out


def commented(df: DataFrame, docs: Mapping[str, str]) -> DataFrame:
    """df with a comment on each column, kept by the tables that it is written to."""
    return df.select(*[F.col(f.name).alias(f.name, metadata={**f.metadata, "comment": docs[f.name]}) if f.name in docs else F.col(f.name) for f in df.schema.fields])


class Versions:
    """Tables of one build in a folder of its own; readers follow a pointer that moves when all are written, so they never see half a build."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def build(self, tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]] | None = None) -> str:
        """Writes every table (compressed, ordered by its key within files) into a new version and points to it; on an error the old version stays."""
        name = f"v-{uuid.uuid4().hex}"
        try:
            for t, df in tables.items():
                out = df.sortWithinPartitions(*keys[t]) if keys and t in keys else df
                out.write.option("compression", "zstd").parquet(f"{self.root}/{name}/{t}")
        except Exception:
            self._fs().delete(self._path(name), True)
            raise
        self.spark.createDataFrame([(name,)], "version string").coalesce(1).write.text(f"{self.root}/{name}/_pointer")
        done = self._path(f"current-{name}")
        self._fs().rename(self._path(f"{name}/_pointer"), done)
        for old in self._fs().listStatus(self._path("")) or []:
            if old.getPath().getName().startswith("current-") and old.getPath().getName() != done.getName():
                self._fs().delete(old.getPath(), True)
        return name

    def current(self) -> str:
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(""))]
        found = [n.removeprefix("current-") for n in names if n.startswith("current-")]
        if len(found) != 1:
            raise ValueError(f"{len(found)} builds are current")
        return found[0]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}/{table}")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A typed table without rows."""
    return spark.createDataFrame([], schema)
