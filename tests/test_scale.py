"""What larger tables showed: prices near nothing and very high ones, panels that are read often, few large groups."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np

from quantloom.operators import ordering
from quantloom.plans import registry, series_queries, study_queries


def test_folds_read_a_kept_panel(spark, sf):
    for name in ("l17_out_of_fold", "l17_fold_metrics"):
        assert not [f for f in registry.QUERIES[name](spark, sf).inputFiles() if "lineitem" in f]


def test_band_of_limits_that_round_to_nothing(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 11.0, 9.0), ("c", None, 9.0)], "ts_code string, up_limit double, down_limit double").selectExpr("*", "date '2020-01-01' as trade_date")
    got = {r["ts_code"]: r["band_pct"] for r in study_queries.p14(lambda t: rows).collect()}
    assert np.isnan(got["a"]) and got["b"] == 10.0 and got["c"] is None


def test_correlation_of_high_prices(spark):
    close = [2e7 + 1e5 * (k * k % 17) for k in range(40)]
    vol = [50 + k * 7 % 11 for k in range(40)]
    rows = spark.createDataFrame([("a", date(2020, 1, 1) + timedelta(k), close[k], vol[k]) for k in range(40)], "ts_code string, trade_date date, close double, vol bigint")
    got = [r["corr_30"] for r in series_queries.w27(lambda t: rows).orderBy("trade_date").collect()]
    assert got[:29] == [None] * 29
    for k in range(29, 40):
        assert abs(got[k] - np.corrcoef(close[k - 29 : k + 1], vol[k - 29 : k + 1])[0, 1]) < 6e-4


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blends_compile_to_small_methods(spark, sf):
    """The JVM never compiles methods of 8,000 bytes or more."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = registry.QUERIES["w30_blends"](spark, sf)._jdf.queryExecution().debug().codegenToSeq()
        assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_trailing_windows_share_one_exchange(spark, sf):
    for name in ("w29_trailing_ic", "w31_rank_average"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 1


def test_spread_grows_with_rows(spark):
    d = ordering.spread(spark.range(1000).selectExpr("id % 50 as k", "id"), "k", rows=100)
    assert d.rdd.getNumPartitions() == 10 and d.count() == 1000


def test_no_task_sorts_a_horizon(spark, sf):
    assert "rank(" not in plan(registry.QUERIES["a17_real_horizons"](spark, sf))
