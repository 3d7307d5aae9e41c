"""Scores, attribution and intraday figures on hand-made cases."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import intraday as I
from quantloom.operators import scoring as C


def day(n):
    return dt.date(2022, 1, 3) + dt.timedelta(days=n)


def test_trend_and_composite(spark):
    shape = "ts_code string, trade_date date, close double, amount double, adx double"
    rows = [("up", day(i), 10 * 1.002**i * (1 + 0.001 * (i % 3)), 5e4, 30.0) for i in range(260)] + [("down", day(i), 50 * 0.99**i, 5e4, 30.0) for i in range(260)]
    rows += [("young", day(i), 5.0, 5e4, 30.0) for i in range(251)] + [("thin", day(i), 10 * 1.002**i, 10.0, 30.0) for i in range(260)] + [("flat", day(i), 5.0, 5e4, None) for i in range(260)]
    df = spark.createDataFrame(rows, shape).repartition(4)
    state = {(r.ts_code, r.trade_date): (r.trend_points, r.trend_state) for r in C.trend(df).collect()}
    assert state["up", day(259)] == (7, "strong_uptrend") and state["down", day(259)] == (0, "strong_downtrend") and state["up", day(198)][1] == "neutral" and state["flat", day(259)] == (0, "downtrend")
    got = {r.ts_code: r for r in C.composite(df, F.lit(0.5), 2e4).collect()}
    assert set(got) == {"up", "down", "flat"} and got["up"].place == 1 and got["down"].place is None and got["flat"].momentum is None and got["flat"].total is None
    x = np.array([r[2] for r in rows if r[0] == "up"])
    change = np.diff(x) / x[:-1]
    expected = (x[-22] / x[-252] - 1) / (change[-251:-21].std(ddof=1) * math.sqrt(230))
    assert got["up"].momentum == pytest.approx(expected) and got["up"].total == pytest.approx(0.4 * expected + 0.3 + 0.1 + 0.1 * 0.25)


def test_trajectory_and_stability(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (None, 2.0, 3.0)], "a double, b double, c double")
    got = df.select(*[v.alias(n) for n, v in C.trajectory(["a", "b", "c"]).items()]).collect()
    assert tuple(got[0]) == pytest.approx((7 / 3, 4.0, np.polyfit([1, 2, 3], [1, 2, 4], 1)[0])) and tuple(got[1]) == (None, None, None)
    rows = spark.createDataFrame([(r, f, v) for r, vs in enumerate([(3.0, 1.0, 2.0), (1.0, 1.0, 5.0)]) for f, v in zip("xyz", vs, strict=True)], "refit int, feature string, importance double")
    s = {r.feature: (r.mean, r.std, r.top_count) for r in C.stability(rows, 1).collect()}
    assert s == {"x": (2.0, 1.0, 1), "y": (1.0, 0.0, 0), "z": (3.5, 1.5, 1)}


def test_attribution(spark):
    e = spark.createDataFrame([(day(0), 0.5, -1.0), (day(1), 1.0, 0.0), (day(2), 9.0, 9.0)], "trade_date date, a double, b double")
    r = spark.createDataFrame([(day(1), 2.0, 1.0), (day(3), -1.0, 3.0)], "trade_date date, a double, b double")
    curve = spark.createDataFrame([(day(0), 100.0, 50.0), (day(1), 110.0, 220.0), (day(3), 99.0, 49.5)], "trade_date date, nav double, invested double")
    got = C.attribution(e, r, curve, ["a", "b"]).orderBy("trade_date").collect()
    # Day 1: exposure of day 0, all invested; day 3: exposure of day 1, half invested.
    assert [(g.a, g.b) for g in got] == [(0, 0), (pytest.approx(0.5 * 0.02), pytest.approx(-0.01)), (pytest.approx(1.0 * -0.01 * 0.5), 0)]
    assert [g.alpha for g in got] == [0, pytest.approx(0.1), pytest.approx(-0.1 + 0.005)]
    assert got[-1].cum_total == pytest.approx(-0.01) and got[-1].cum_alpha == pytest.approx(1.1 * 0.905 - 1)


def test_microstructure(spark):
    at = lambda d, m: dt.datetime(2024, 1, d, 10, m)
    ticks = [("s", at(1, 0), 0, 10.0, 1), ("s", at(1, 1), 1, 12.0, 0), ("s", at(1, 1), 2, 11.0, 0), ("s", at(1, 31), 3, 10.0, 1), ("s", at(2, 0), 4, 20.0, 1), ("s", at(2, 40), 5, None, 1), ("t", at(1, 0), 6, 5.0, 0)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, id long, price double, taker int")
    bars = I.tick_bars(df, "symbol", "ts", "30 minutes", "price", F.col("taker"), ["id"])
    assert {(r.symbol, r.ts.day, r.ts.minute): (r.open, r.high, r.low, r.close, r.volume, r.taker_buy) for r in bars.collect()} == {("s", 1, 0): (10, 12, 10, 11, 3, 1), ("s", 1, 30): (10, 10, 10, 10, 1, 1), ("s", 2, 0): (20, 20, 20, 20, 1, 1), ("t", 1, 0): (5, 5, 5, 5, 1, 0)}
    got = {(r.symbol, r.day.day): r for r in I.daily_microstructure(bars, "symbol", "ts", least=1, jump=1.5).collect()}
    first, second = got["s", 1], got["s", 2]
    assert first.rv == pytest.approx(abs(math.log(10 / 11))) and first.bipower == 0 and first.jump == pytest.approx(first.rv) and first.semi_skew == -1 and first.skew is None
    assert first.range_pct == pytest.approx(0.2) and first.taker_ratio == 0.5 and first.concentration == pytest.approx((9 + 1) / 16 * 2)
    # Day 2: its return of log 2 against the day before's, the median of both being their mean.
    assert second.bipower == pytest.approx(math.sqrt(math.log(2) * math.log(1.1) * math.pi / 2)) and second.jump_count == 1
    assert got["t", 1].rv == 0 and got["t", 1].efficiency is None and got["t", 1].kurt is None
