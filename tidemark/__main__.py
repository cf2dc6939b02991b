"""python -m tidemark: queries, as-of SQL, audits and reports from a shell."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import asof, calendar, model
from tidemark.plans import catalogue
from tidemark.plans.pointintime import RULES
from tidemark.sources import tables

VERSION = "0.2"


def session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description="Point-in-time analytics on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="the version")
    commands.add_parser("queries", help="names of the registered queries, those with SQL marked")
    run = commands.add_parser("run", help="run a registered query over a folder of tables")
    run.add_argument("query", choices=sorted(catalogue.QUERIES))
    sql = commands.add_parser("asof", help="SQL over the tables as they were known at a moment")
    sql.add_argument("as_of", help="a date, or a moment with its zone")
    sql.add_argument("sql")
    audit = commands.add_parser("audit", help="key audit and content hash of a table")
    audit.add_argument("table")
    audit.add_argument("key", nargs="+")
    weeks = commands.add_parser("weeks", help="the calendar of a table's days")
    weeks.add_argument("table")
    weeks.add_argument("day")
    export = commands.add_parser("export", help="write a query's result as Parquet, whole or not at all")
    export.add_argument("query", choices=sorted(catalogue.QUERIES))
    export.add_argument("path")
    for c in (run, sql, audit, weeks, export):
        c.add_argument("--data", required=True, help="folder with <table>.parquet")
    for c in (run, sql, audit, weeks):
        c.add_argument("--format", choices=("markdown", "csv", "html"), default="markdown")
        c.add_argument("--rows", type=int, default=100, help="rows shown; a longer result is an error")
    return top


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command in ("run", "export"):
        return catalogue.QUERIES[args.query](spark, args.data)
    if args.command == "asof":
        names = asof.mentioned(args.sql, RULES)
        load = {n: lambda s, n=n: tables.table(s, args.data, n) for n in names}
        return asof.AsOfSession(spark, load, RULES, asof.moment(args.as_of)).sql(args.sql)
    frame = tables.table(spark, args.data, args.table)
    if args.command == "audit":
        return model.key_audit(frame, args.key).crossJoin(model.content_hash(frame).drop("n"))
    from pyspark.sql import functions as F

    days = frame.select(F.year(args.day).alias("season"), F.weekofyear(args.day).alias("week"), F.to_date(args.day).alias("day"))
    return calendar.weeks(days, "season", "week", "day").orderBy("season", "week")


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
    elif args.command == "queries":
        for name in sorted(catalogue.QUERIES):
            print(f"{name}{' (SQL)' if name in catalogue.ORACLE_SQL else ''}")
    elif args.command == "export":
        tables.replace_atomically(result(session(), args), args.path)
    else:
        try:
            print(tables.report(result(session(), args), args.format, args.rows), end="")
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
