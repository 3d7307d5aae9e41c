"""Every query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import pytest

from quantloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_twin(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    answer = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_twin_has_rows(name, spark, sf):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
