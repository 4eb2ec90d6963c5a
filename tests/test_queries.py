"""Every core query against its SQL twin in DuckDB; those without SQL must run and keep their schema."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from millrace.plans import registry


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, data, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(set(columns)) == len(columns)
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
