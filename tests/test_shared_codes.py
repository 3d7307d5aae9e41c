"""Tables of more suppliers than four digits tell apart: instruments that share a code all count, as in the SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from quantloom.plans import registry

#: Suppliers of one code each: the first four digits and the remainder by four are the code.
SHARED = ((1001, 10013), (1002, 10022), (7, 7))


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """Bars of suppliers who share codes; their days lie apart, so that ordering by code and day leaves no ties."""
    folder, rows = tmp_path_factory.mktemp("shared"), []
    for pair in SHARED:
        for i in range(120):
            day = datetime(1996, 1, 1) + timedelta(i * 5 % 700)
            rows.append((len(rows), i, pair[(day - datetime(1996, 1, 1)).days % 2], 1, 10.0 + i % 40, 1000.0 + i, (i * 7 % 11) / 100, (i * 3 % 9) / 100, "ANR"[i % 3], "FO"[i % 2], day))
    shape = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["a42_membership"])
def test_query_equals_twin_where_codes_are_shared(name, spark, shared):
    duckdb = pytest.importorskip("duckdb")
    df = registry.QUERIES[name](spark, shared)
    got = sorted((tuple(map(str, r)) for r in df.collect()))
    answer = duckdb.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name].replace('from lineitem', f'''from '{shared}/lineitem.parquet/*.parquet' ''')}) x")
    assert got == sorted(tuple(map(str, r)) for r in answer.fetchall())


def test_valuations_are_carried_back_by_one_pass(spark, sf):
    assert "currentrow$(), unboundedfollowing$()" not in registry.QUERIES["w56_valuation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
