"""Prices that come down to 0 and rise from it, as long paths of instruments that share a code do."""

from __future__ import annotations

import math

import pytest

from quantloom.functions.columns import quantise
from quantloom.plans import registry
from quantloom.plans.base import scaled

ROWS = 1700


@pytest.fixture(scope="module")
def fallen(tmp_path_factory):
    """Bars of three suppliers; the price of the first falls to 0, rises, and falls again."""
    duckdb = pytest.importorskip("duckdb")
    folder = tmp_path_factory.mktemp("fallen")
    duckdb.sql(f"""copy (select s as l_suppkey, cast(1 + (d * 7 + s) % 40 as double) as l_quantity, 30000e0 + d as l_extendedprice, ((d * 5 + s) % 9) / 1e2 as l_tax, timestamp '1996-01-01' + d * interval 1 day as l_shipdate,
      case when s = 7 and (d < 140 or d >= 260 and d < 420) then 0e0 when s = 7 and d < 260 then 1e-1 else ((d * 37 + s * 11) % 11) / 1e2 end as l_discount
      from (values (cast(7 as bigint)), (8), (9)) t(s), range(600) r(d) where s < 9 or d < 500) to '{folder}/lineitem.parquet' (format parquet)""")
    return str(folder)


def plain(v):
    return str(v if not isinstance(v, float) or not math.isfinite(v) else round(v, 9) + 0.0)


@pytest.mark.parametrize("name", ["s01_series_files", "ts7_keyed_state", "w40_ranking", "w57_feature_set"])
def test_query_equals_twin(name, spark, fallen):
    import duckdb

    df = registry.QUERIES[name](spark, fallen)
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    answer = duckdb.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name].replace('from lineitem', f'''from '{fallen}/lineitem.parquet' ''')}) x")
    assert got == sorted(tuple(map(plain, r)) for r in answer.fetchall())


@pytest.mark.parametrize(("name", "rows"), [("w05_volatility", ROWS), ("w29_trailing_ic", ROWS - 3 * 20), ("w30_blends", ROWS - 3 * 20), ("l20_drift_classifier", 1), ("a05_cross_section_stats", 500)])
def test_query_whose_sql_stops_is_whole(name, rows, spark, fallen):
    assert len(registry.QUERIES[name](spark, fallen).collect()) == rows


def test_units_and_rounding_of_what_is_no_number(spark):
    values = [1.23456, 1e17, -1e17, float("inf"), float("-inf"), float("nan"), None]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in d.select(quantise(d.x).alias("q"), scaled("x", 2).alias("n")).collect()]
    assert got[0] == (1.2346, 123) and got[1] == (1e17, 2**63 - 1) and got[2] == (-1e17, -(2**63))
    assert [g[0] for g in got[3:5]] == [float("inf"), float("-inf")] and math.isnan(got[5][0]) and got[6][0] is None
    assert [g[1] for g in got[3:]] == [None] * 4
