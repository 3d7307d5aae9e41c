"""Histories, windows of vectors, grids and setups on edge cases."""

from __future__ import annotations

import datetime as dt

import pytest

from quantloom.operators import snapshots as S


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_histories_keep_nulls_and_order(spark):
    rows = [("a", day(i), None if i == 3 else float(i)) for i in range(6)] + [("b", day(9), 1.0)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, x double").repartition(3)
    got = {r.ts_code: (r.trade_date, r.n, r.x_path) for r in S.histories(df, ["x"], 4).collect()}
    assert got == {"a": (day(5), 4, [2.0, None, 4.0, 5.0]), "b": (day(9), 1, [1.0])}
    assert S.histories(df.limit(0), ["x"], 4).count() == 0


def test_vectors_of_days_and_windows(spark):
    items = [("k", day(0), [1.0, 2.0]), ("k", day(0), [3.0, 4.0]), ("k", day(2), [5.0, 6.0]), ("k", day(2), [1.0]), ("k", day(3), None), ("l", day(1), [7.0, 8.0])]
    days = S.day_vectors(spark.createDataFrame(items, "k string, d date, v array<double>"), "k", "d", "v", 2)
    assert {(r.k, r.d): (r.v, r.n) for r in days.collect()} == {("k", day(0)): ([2.0, 3.0], 2), ("k", day(2)): ([5.0, 6.0], 1), ("l", day(1)): ([7.0, 8.0], 1)}
    got = {(r.k, r.d): r.window for r in S.vector_window(days, "k", "d", "v", 2, 3).collect()}
    assert got["k", day(2)] == [[2.0, 3.0], [0.0, 0.0], [5.0, 6.0]] and got["l", day(1)] == [[0.0, 0.0], [0.0, 0.0], [7.0, 8.0]]


def test_resampled_fills_from_before_only(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [("s", at(1, 5), 1.0), ("s", at(1, 50), 3.0), ("s", at(4), 5.0), ("s", at(2), None), ("t", at(7), 1.0)]
    got = sorted((r.s, r.at.hour, r.v, r.filled) for r in S.resampled(spark.createDataFrame(rows, "s string, at timestamp, v double"), "s", "at", "v", "1 hour", 3600).collect())
    assert got == [("s", 1, 2.0, False), ("s", 2, 2.0, True), ("s", 3, 2.0, True), ("s", 4, 5.0, False), ("t", 7, 1.0, False)]


def test_setups(spark):
    rows = [("up", day(i), 10.0 + i * 0.01, 9.0, 10.0 + i * 0.01, 100) for i in range(69)] + [("up", day(69), 12.0, 11.9, 12.0, 50)] + [("new", day(0), 1.0, 1.0, 1.0, 1)]
    got = {r.ts_code: r for r in S.setups(spark.createDataFrame(rows, "ts_code string, trade_date date, high double, low double, close double, vol long")).collect()}
    assert got["up"].breakout and not got["up"].squeeze and not any((got["new"].breakout, got["new"].pullback, got["new"].squeeze))


def test_quarter_starts(spark):
    rows = [("a", day(i), 100.0 + i, 5.0) for i in range(120)]
    got = S.quarter_starts(spark.createDataFrame(rows, "ts_code string, trade_date date, close double, amount double")).orderBy("trade_date").collect()
    assert [(r.trade_date, r.listed_bars) for r in got] == [(day(0), 1), (dt.date(2024, 4, 1), 92)]
    assert got[0].ret_20 is None and got[1].ret_20 == pytest.approx(190 / 170 - 1) and got[1].drawdown_60 == 0 and got[1].ret_250 is None and got[1].turnover_20 == 5
