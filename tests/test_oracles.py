"""Every registered query that has SQL against DuckDB on the smallest tables; the others run and keep their schema."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from codequery.plans.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(plain(x) for x in r) for r in found.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    assert df.schema == QUERIES[name](spark, DIR).schema
    df.collect()
