"""Table specs: names, types, keys; typed projection and audits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column: its type, the source column (its own name by default), or a SQL expression over the source."""

    name: str
    kind: str
    source: str | None = None
    derived: str | None = None
    doc: str = ""


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    order: tuple[str, ...] = ()  # the first row of a key under this order stays
    not_null: tuple[str, ...] = field(default=())

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(f.kind), metadata={"doc": f.doc}) for f in self.fields])

    def project(self, df: DataFrame) -> DataFrame:
        """df's columns under this spec. A missing source column is a typed null; an empty string is null; a cast that fails is an error."""
        out = []
        for f in self.fields:
            source = f.source or f.name
            if f.derived:
                c = F.expr(f.derived)
            elif source in df.columns:
                c = F.col(source)
                if dict(df.dtypes)[source] == "string":
                    c = F.when(F.trim(c) != "", c)
            else:
                c = F.lit(None)
            out.append(c.cast(f.kind).alias(f.name))
        return df.select(*out)

    def build(self, df: DataFrame) -> DataFrame:
        """Projection, rows without a needed column dropped, one row a key."""
        out = self.project(df)
        if self.not_null:
            out = out.dropna(subset=list(self.not_null))
        if self.order:
            w = Window.partitionBy(*self.key).orderBy(*[F.expr(o) if " " not in o else F.col(o.split()[0]).desc() for o in self.order])
            out = out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        return out


def key_audit(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys held by two or more rows, rows with a null in the key. Nulls are equal."""
    per = df.groupBy(*key).agg(F.count("*").alias("c"))
    nulls = F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0))
    return per.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count_if(F.col("c") > 1).alias("n_repeated"),
        F.coalesce(F.sum(nulls * F.col("c")), F.lit(0)).cast("long").alias("n_null_rows"),
    )


def drift(df: DataFrame, spec: Table) -> dict[str, list[str]]:
    """Columns that a source lacks, has besides, or has in another type."""
    have, want = dict(df.dtypes), {f.source or f.name: f.kind for f in spec.fields if not f.derived}
    return {
        "missing": sorted(want.keys() - have.keys()),
        "added": sorted(have.keys() - want.keys()),
        "retyped": sorted(c for c in want.keys() & have.keys() if have[c] != T._parse_datatype_string(want[c]).simpleString()),
    }


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of all of them, two sums of independent 64-bit row hashes. No sort, no shuffle of rows."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    one, two = F.xxhash64(*text), F.xxhash64(F.lit("second"), *text)
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n"), F.concat_ws("/", total(one), total(two)).alias("hash"))


def portable_hash(df: DataFrame) -> DataFrame:
    """One row: rows and the md5 of all rows' md5s in order, nulls skipped. For tables of a known small size: the sort is in one task."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]))
    return df.select(row.alias("h")).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("hash"))
