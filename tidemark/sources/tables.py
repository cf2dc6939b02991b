"""Sources and sinks: Parquet, CSV and JSON under a declared schema, Parquet by partition."""

from __future__ import annotations

import atexit
import contextlib
import csv
import hashlib
import html
import io
import json
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str | list[str], kind: str = "parquet", schema: T.StructType | None = None, with_file: bool = False) -> DataFrame:
    """A table; columns that some files lack are null, with_file adds `_file`. CSV needs a schema: types are declared, never guessed."""
    reader = spark.read
    if kind == "csv":
        if schema is None:
            raise ValueError("a CSV is read under a declared schema")
        reader = reader.option("header", True).option("mode", "FAILFAST")
    elif kind == "parquet":
        reader = reader.option("mergeSchema", schema is None and isinstance(path, list))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(kind).load(path)
    return df.withColumn("_file", F.col("_metadata.file_path")) if with_file else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for a table of this run: below spark.checkpoint.dir, or, only in local runs where that is unset, a temporary one. It goes when the run ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before the interpreter
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def snapshot(df: DataFrame) -> str:
    """The schema as JSON: the contract that a later read is held against."""
    return json.dumps({f.name: f.dataType.simpleString() for f in df.schema.fields}, sort_keys=True)


def by_season(spark: SparkSession, paths: Mapping[int, str], season: str = "season") -> DataFrame:
    """Files of one source by season, as one table: types are widened, columns that a season lacks are null there, the season is a column. A filter on it leaves the other files unread."""
    from tidemark.operators.build import relaxed_union

    return relaxed_union([spark.read.parquet(p).withColumn(season, F.lit(s)) for s, p in sorted(paths.items())])


def resolved(spark: SparkSession, root: str, dataset: str, seasons: Iterable[int], first: int = 0) -> dict[int, str]:
    """Season: path of <root>/<dataset>_<season>.parquet, for seasons from `first` on. All that are missing are reported together."""
    jvm, out, gone = spark._jvm, {}, []
    for s in seasons:
        path = f"{root.rstrip('/')}/{dataset}_{s}.parquet"
        where = jvm.org.apache.hadoop.fs.Path(path)
        if s < first:
            continue
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out[s] = path
        else:
            gone.append(s)
    if gone:
        raise FileNotFoundError(f"{dataset}: no files for {gone}")
    return out


def split_by_layout(spark: SparkSession, paths: Iterable[str], column: str) -> tuple[list[str], list[str]]:
    """Paths whose footers have `column`, and the others: two layouts of one source are read apart."""
    have, lack = [], []
    for p in paths:
        (have if column in spark.read.parquet(p).columns else lack).append(p)
    return have, lack


def n_rows(spark: SparkSession, path: str) -> int:
    """Rows by the footers alone: the count is pushed down to the Parquet reader and no column is read."""
    own = spark.newSession()  # settings of its own
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    return own.read.parquet(path).groupBy().count().first()[0]


def append_snapshot(df: DataFrame, path: str, key: str = "as_of") -> int:
    """Appends the snapshots (values of `key`) of df that the table at path doesn't have yet; returns how many. Running it again adds nothing, and what is there never changes."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    n = df.select(key).distinct().count()
    if n:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return n


def replace_atomically(df: DataFrame, path: str) -> None:
    """Writes df beside path and moves it into place, so a failed write leaves the old table; compressed with zstd."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(aside)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{aside}-old"
    had = fs.exists(of(path))
    if had:
        fs.rename(of(path), of(old))
    if not fs.rename(of(aside), of(path)):
        fs.rename(of(old), of(path))
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(of(old), True)


def report(df: DataFrame, kind: str = "markdown", most: int = 1000) -> str:
    """A small table as text: csv, markdown or html. One of more than `most` rows is an error: a report isn't an export."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    text = [["" if v is None else str(v) for v in r] for r in rows]
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([df.columns, *text])
        return out.getvalue()
    if kind == "markdown":
        line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, text)]) + "\n"
    if kind == "html":
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        return "<table>" + row(df.columns, "th") + "".join(row(r, "td") for r in text) + "</table>"
    raise ValueError(f"unknown kind {kind}")


def config(spark: SparkSession, path: str, required: Mapping[str, type]) -> dict:
    """A JSON object of settings; a missing or wrongly typed one, or one that isn't asked for, is an error."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    got = json.loads(text)
    bad = [k for k, kind in required.items() if not isinstance(got.get(k), kind)] + sorted(got.keys() - required.keys())
    if bad:
        raise ValueError(f"settings: {bad}")
    return got


class Artifacts:
    """Small models as JSON under a folder, by name, each pinned by the sha256 of its text: what is loaded is what was saved."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, model: dict) -> str:
        text = json.dumps(model, sort_keys=True)
        pin = hashlib.sha256(text.encode()).hexdigest()
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}-{pin[:16]}")
        return pin

    def load(self, name: str, pin: str) -> dict:
        text = self.spark.read.text(f"{self.root}/{name}-{pin[:16]}").first().value
        if hashlib.sha256(text.encode()).hexdigest() != pin:
            raise ValueError(f"{name} is not what was pinned")
        return json.loads(text)


def attached(spark: SparkSession, root: str, names: Iterable[str], prefix: str = "wh_") -> list[str]:
    """Tables of a folder as views wh_<name> of the session, read when used; returns the views' names."""
    out = []
    for n in names:
        view = prefix + n.removesuffix(".parquet")
        spark.read.parquet(f"{root.rstrip('/')}/{n}").createOrReplaceTempView(view)
        out.append(view)
    return out


def write(df: DataFrame, path: str, mode: str = "replace", by: list[str] | None = None) -> None:
    """replace: the whole table; append; upsert: the partitions that df has."""
    writer = df.write.partitionBy(*by) if by else df.write
    if mode == "upsert":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if mode == "append" else "overwrite").parquet(path)
