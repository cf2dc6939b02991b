"""What the training-data operators share: tables, the shared folder, words, tokenizers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_dir() -> str:
    """A temporary folder of this process, gone at its end."""
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, only in local runs where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{own_dir()}"
    return f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_if_it_runs(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before the interpreter
        drop(spark, path)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """path goes when the application ends."""
    atexit.register(_drop_if_it_runs, spark, path)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read from a table in the shared folder: lineage ends there, so a lost executor costs no recomputation of what went before. The table goes when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    drop_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes the table behind a frame from written() that nothing will read any more."""
    if df is not None and hasattr(df, "_tidemark_path"):
        drop(df.sparkSession, df._tidemark_path)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
