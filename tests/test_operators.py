"""Hand-made edge cases and metamorphic checks of the operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import clip, quantise, safe_div
from quantloom.operators import cross_section, joins, labels, text, timeseries, vectors

D = lambda n: dt.date(2024, 1, n)


def test_asof_takes_last_duplicate_keeps_null_and_age(spark):
    left = spark.createDataFrame([("a", D(n)) for n in (1, 2, 3, 5)], "ts_code string, trade_date date")
    right = spark.createDataFrame([("a", D(2), 1, 10), ("a", D(2), 2, 20), ("a", D(4), 3, None)], "ts_code string, ann date, seq int, v int")
    one = joins.keep_last(right, ["ts_code", "ann"], ["seq"])
    got = {r.trade_date.day: (r.v, r.ann) for r in joins.asof_join(left, one, "ts_code", "trade_date", "ann", ["v"]).collect()}
    assert got == {1: (None, None), 2: (20, D(2)), 3: (20, D(2)), 5: (None, D(4))}
    aged = {r.trade_date.day: r.ann for r in joins.asof_join(left, one, "ts_code", "trade_date", "ann", ["v"], max_age=0).collect()}
    assert aged == {1: None, 2: D(2), 3: None, 5: None}


def test_intervals_are_inclusive_open_and_make_no_rows(spark):
    left = spark.createDataFrame([("a", D(n)) for n in range(1, 12)] + [("b", D(1))], "ts_code string, trade_date date")
    spans = spark.createDataFrame([("a", D(2), D(5)), ("a", D(3), D(4)), ("a", D(5), D(6)), ("a", D(8), D(8)), ("a", D(10), None)], "ts_code string, s date, e date")
    got = joins.in_interval(left, spans, "ts_code", "trade_date", "s", "e", "inside").collect()
    assert len(got) == 12
    assert {r.trade_date.day for r in got if r.inside} == {2, 3, 4, 5, 6, 8, 10, 11}


def test_rolling_needs_its_minimum_and_looks_only_back(spark):
    values = [1.0, None, 3.0, 4.0, 5.0, 100.0]
    bars = spark.createDataFrame([("a", D(i + 1), v) for i, v in enumerate(values)], "ts_code string, trade_date date, x double")
    run = lambda d: [r.m for r in d.select("trade_date", timeseries.rolling(F.avg, "x", 3).alias("m")).orderBy("trade_date").collect()]
    whole = run(bars)
    assert whole[:5] == [None, None, None, None, 4.0]
    assert run(bars.where(F.col("trade_date") < D(6))) == whole[:5]


def test_ewm_equals_pandas():
    x = np.array([np.nan, 1.0, 2.0, np.nan, 5.0])
    got = timeseries.ewm_mean(x, 0.3)
    assert np.isnan(got[0]) and got[1] == 1.0 and got[2] == pytest.approx(1.3) and got[3] == got[2]
    y = np.random.default_rng(0).normal(size=50)
    assert np.allclose(timeseries.ewm_mean(y, 0.2), pd.Series(y).ewm(alpha=0.2, adjust=False).mean())


def test_streaks(spark):
    flags = [True, True, False, True, None, True, True, True]
    df = spark.createDataFrame([("a", D(i + 1), f) for i, f in enumerate(flags)], "ts_code string, trade_date date, f boolean")
    assert [r.n for r in timeseries.with_streak(df, F.col("f"), "n").orderBy("trade_date").collect()] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_percent_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, None), (2, 7.0)], "d int, x double")
    got = sorted(r.p for r in cross_section.percent_rank(df, "x", ["d"], "p").collect())
    want = [*pd.Series([2.0, 2.0, 1.0]).rank(pct=True), 0.5, 1.0]
    assert got == pytest.approx(sorted(want))


def test_quantile_bins_equal_pandas(spark):
    x = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 9.0]
    df = spark.createDataFrame([(1, v) for v in x] + [(1, None)], "d int, x double")
    got = [r.b for r in cross_section.quantile_bins(df, "x", ["d"], 4, "b").orderBy("x").collect()]
    assert got[1:] == list(pd.qcut(x, 4, labels=False, duplicates="drop")) and got[0] is None


def test_walk_forward_bounds(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(n),) for n in range(60)], "trade_date date")
    folds = labels.walk_forward(days, 20, 5, 10, 5, 10, 5).toPandas()
    assert set(folds.fold) == {0, 1}
    sizes = folds.groupby(["fold", "split"]).size()
    assert sizes[(0, "train")] == 20 and sizes[(1, "test")] == 10 and sizes[(0, "gap")] == 10
    with pytest.raises(ValueError):
        labels.walk_forward(days, 20, 1, 10, 5, 10, 5)


def test_text_helpers(spark):
    df = spark.createDataFrame([("  A-b C!",), ("...",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalise(F.col("t"))).collect()] == ["abc", "", ""]
    assert [r[0] != "" for r in df.select(text.content_hash(F.col("t"))).collect()] == [True, False, False]
    assert df.limit(1).select(text.ngrams(F.lit("abcd"), 2, 3)).first()[0] == ["ab", "bc", "cd", "abc", "bcd"]


def test_vectors_of_length_zero_and_ties(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    got = vectors.top_k(rows.where("id = 0"), rows, "id", "v", 2).orderBy("rank").collect()
    assert [(r.row_id, r.score) for r in got] == [(1, 1.0), (2, 0.0)]


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None]
    assert [r[0] for r in df.select(clip(F.col("a"), -1.0, 1.5)).collect()] == [1.0, 1.5, None]
    assert df.select(quantise(F.lit(0.12345), 4)).first()[0] == 0.1235
