"""Tables as they were known at a moment.

Every event row has `available_at`, the earliest moment at which the whole row was public. Features read available_at <= as_of, outcomes
available_at > as_of. The predicates are plain comparisons, so they reach the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def moment(as_of: str | dt.datetime | dt.date) -> dt.datetime:
    """A UTC moment without zone. A moment must say its zone, in words or as a datetime; a date is its end in UTC."""
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of) if len(as_of) == 10 else dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is None:
            raise TypeError(f"a moment without zone: {as_of}")
        return as_of.astimezone(dt.UTC).replace(tzinfo=None)
    if not isinstance(as_of, dt.date):
        raise TypeError(f"not a moment: {as_of!r}")
    return dt.datetime.combine(as_of, dt.time.max)


_WEEK = re.compile(r"(\d{4})-W(\d{1,2})")


def parse(text: str) -> tuple[int, int] | dt.datetime:
    """What a user types: '2024-W7' is (season, week), all else a moment with its zone."""
    if m := _WEEK.fullmatch(text.strip()):
        return int(m[1]), int(m[2])
    try:
        when = dt.datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise ValueError(f"neither a week like 2024-W7 nor a moment with a zone: {text!r}") from e
    return moment(when)


def stamp(as_of) -> Column:
    """A literal of the moment. A datetime without zone is taken for what moment() gives."""
    plain = as_of if isinstance(as_of, dt.datetime) and as_of.tzinfo is None else moment(as_of)
    return F.lit(plain.isoformat(sep=" ")).cast("timestamp_ntz")


def checked(df: DataFrame, column: str = "available_at") -> DataFrame:
    """df if `column` can decide what is known: it is there, a moment, never null, and the only one of its kind (a join leaves a second,
    and which of them holds for the row is then not said). One pruned scan, which stops at the first null."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if others := [c for c in df.columns if c != column and (c.startswith(f"{column}_") or c.endswith(f"_{column}"))]:
        raise ValueError(f"a joined table: {others} beside {column}")
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("timestamp", "timestamp_ntz"):
        raise TypeError(f"{column} is {kind}, not a moment")
    if not df.where(F.col(column).isNull()).select(F.lit(1)).limit(1).isEmpty():
        raise ValueError(f"{column} is null in some rows")
    return df


def known(df: DataFrame, as_of, column: str = "available_at", check: bool = True) -> DataFrame:
    """Rows known at a moment, that moment included. check: see checked(); views of declared tables, audited when built, go without."""
    return (checked(df, column) if check else df).where(F.col(column) <= stamp(as_of))


def outcomes(df: DataFrame, as_of, until=None, column: str = "available_at", check: bool = True) -> DataFrame:
    """Rows that became known after as_of, and by `until`: the complement, for labels."""
    out = (checked(df, column) if check else df).where(F.col(column) > stamp(as_of))
    return out if until is None else out.where(F.col(column) <= stamp(until))


def mentioned(text: str, names: Iterable[str]) -> list[str]:
    """Tables that a SQL text may use: names that stand in it as words. It may name too many, never too few."""
    words = set(re.findall(r"\w+", text.lower()))
    return sorted(n for n in names if n.lower() in words)


@dataclass(frozen=True)
class Rule:
    """How a table is shown: event (by available_at), static (always), hindsight (by available_at, `allowed` columns only), meta (never).

    masks: column -> column with the moment from which it is known; before, it is null.
    """

    kind: str
    available: str | None = None
    masks: dict[str, str] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()

    def with_time(self, df: DataFrame) -> DataFrame:
        return df.withColumn("available_at", F.expr(self.available)) if self.available else df

    def future(self, as_of) -> Column:
        """Rows that a view of this kind doesn't show: later ones, and of hindsight tables those without a moment."""
        at = F.expr(self.available) if self.available else F.col("available_at")
        late = at > stamp(as_of)
        return at.isNull() | late if self.kind == "hindsight" else late

    def masked(self, column: str, as_of) -> Column:
        """Where a masked column isn't public yet; without a moment it never is."""
        return F.coalesce(F.expr(self.masks[column]) > stamp(as_of), F.lit(True))

    def view(self, df: DataFrame, as_of) -> DataFrame | None:
        if self.kind == "meta":
            return None
        shown = df if self.kind == "static" else known(self.with_time(df), as_of, check=False)
        if self.masks:
            shown = shown.withColumns({c: F.when(~self.masked(c, as_of), F.col(c)) for c in self.masks})
        return shown.select(*self.allowed) if self.allowed else shown


class AsOfSession:
    """SQL over the tables as known at one moment: a session of its own, in which only the compiled views have names.

    tables: name -> loader (session -> frame). A table without a rule is refused.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, Callable[[SparkSession], DataFrame]], rules: dict[str, Rule], as_of) -> None:
        if missing := sorted(tables.keys() - rules.keys()):
            raise ValueError(f"no availability rule: {missing}")
        self.session, self.views = spark.newSession(), {}
        self.as_of = as_of if isinstance(as_of, dt.datetime) and as_of.tzinfo is None else moment(as_of)
        for name, load in tables.items():
            shown = rules[name].view(load(self.session), self.as_of)
            if shown is not None:
                shown.createOrReplaceTempView(name)
                self.views[name] = shown

    def sql(self, text: str) -> DataFrame:
        return self.session.sql(text)


class World:
    """What a build may read: view(name), the table as known, and raw(name), the table itself. The harness changes what lies under both."""

    def __init__(self, tables: dict[str, DataFrame], rules: dict[str, Rule], as_of) -> None:
        self._tables, self._rules, self.as_of = tables, rules, as_of

    def view(self, name: str) -> DataFrame:
        shown = self._rules[name].view(self._tables[name], self.as_of)
        if shown is None:
            raise ValueError(f"{name} isn't shown")
        return shown

    def raw(self, name: str) -> DataFrame:
        return self._tables[name]


def scrambled(c: Column, kind: str) -> Column:
    """Another value of the same type for every value of the common types; a null becomes one too, where the type has an obvious one."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(c.bitwiseXOR(F.lit(1).cast(kind)), F.lit(1).cast(kind))
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.coalesce(-c - F.lit(1).cast(kind), F.lit(1).cast(kind)).cast(kind)
    if kind == "boolean":
        return ~F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.concat(F.lit("~"), F.reverse(F.coalesce(c, F.lit(""))))
    if kind in ("timestamp", "timestamp_ntz"):
        return c + F.expr("interval 1 day")
    if kind == "date":
        return F.date_add(c, 1)
    return F.lit(None).cast(kind)


def _without_future(df: DataFrame, rule: Rule, as_of) -> DataFrame:
    return df.where(~F.coalesce(rule.future(as_of), F.lit(False))) if rule.kind in ("event", "hindsight") else df


def _scrambled_future(df: DataFrame, rule: Rule, as_of) -> DataFrame:
    """df with every value that isn't public at as_of changed: rows of the future (but for what dates them), masked columns, columns that
    hindsight tables never show."""
    dates = set(re.findall(r"\w+", " ".join([rule.available or "available_at", *rule.masks.values()])))
    late = F.coalesce(rule.future(as_of), F.lit(False)) if rule.kind in ("event", "hindsight") else F.lit(False)
    changed = {}
    for c, kind in df.dtypes:
        if c in dates:
            continue
        hidden = late
        if c in rule.masks:
            hidden = hidden | rule.masked(c, as_of)
        if rule.allowed and c not in rule.allowed:
            hidden = F.lit(True)
        changed[c] = F.when(hidden, scrambled(F.col(c), kind)).otherwise(F.col(c))
    return df.withColumns(changed)


def invariant(build: Callable[[World], DataFrame], tables: dict[str, DataFrame], rules: dict[str, Rule], as_of) -> DataFrame:
    """Leakage proof: rows that `build` gives differently (variant, and the row) when all that was not public at as_of is deleted, or
    scrambled. Empty when nothing leaks. A build must read its tables through the World that it is given: what it takes from elsewhere can't be changed under it."""
    whole = build(World(tables, rules, as_of))
    out = None
    for variant, change in (("deleted", _without_future), ("scrambled", _scrambled_future)):
        got = build(World({n: change(df, rules[n], as_of) for n, df in tables.items()}, rules, as_of))
        differ = whole.exceptAll(got).unionAll(got.exceptAll(whole)).withColumn("variant", F.lit(variant))
        out = differ if out is None else out.unionAll(differ)
    return out


def difference(expected: DataFrame, got: DataFrame, key: list[str], rel: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """(key, what): keyed rows that differ: 'missing', 'new', or the names of the columns that do. Numbers may differ by absolute + rel * |expected|."""
    cols = [c for c in expected.columns if c not in key]
    kinds = dict(expected.dtypes)
    a = expected.select(*[F.col(k).alias(f"a_{k}") for k in key], F.struct(*cols).alias("a"), F.lit(True).alias("in_a"))
    b = got.select(*[F.col(k).alias(f"b_{k}") for k in key], F.struct(*cols).alias("b"), F.lit(True).alias("in_b"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, on, "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if kinds[c] in ("double", "float"):
            near = (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= absolute + rel * F.abs(x))
            return ~F.coalesce(near, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    names = F.concat_ws(",", *[F.when(differs(c), F.lit(c)) for c in cols])
    what = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "new").otherwise(names)
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key], what.alias("what")).where("what <> ''")
