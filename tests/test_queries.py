"""Every query that has SQL gives the same rows as an independent engine, names and kinds of columns included."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = plain(map(tuple, got.select(*cols).collect()))
    sql = catalogue.ORACLE_SQL.get(name)
    if sql is None:
        assert rows
        return
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})")
    kinds = {d[0]: str(d[1]) for d in want.description}
    expected = plain(want.fetchall())
    assert rows == expected, (rows[:3], expected[:3])
    short = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    assert {c: short[k] for c, k in got.dtypes} == {c: kinds[c] for c in cols}
