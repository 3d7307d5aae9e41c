"""Reports and technical sets on hand-made edge cases."""

from __future__ import annotations

import datetime as dt

import pytest

from quantloom.operators import reports as R
from quantloom.operators import technicals as X


def day(n):
    return dt.date(2022, 1, 3) + dt.timedelta(days=n)


def test_nav_of_one_day_and_of_a_known_curve(spark):
    one = R.nav_report(spark.createDataFrame([(day(0), 5.0)], "trade_date date, nav double")).first()
    assert one.n == 0 and one.total == 0 and one.cagr is None and one.vol is None and one.sharpe is None and one.max_drawdown == 0
    curve = [100.0, 110.0, 110.0, 99.0, 104.5, 88.0, 120.0]
    r = R.nav_report(spark.createDataFrame([(day(i), v) for i, v in enumerate(curve)], "trade_date date, nav double").repartition(3), rf=0.0).first()
    assert (r.n, r.peak, r.trough) == (6, day(1), day(5))
    assert r.max_drawdown == pytest.approx(-0.2) and r.total == pytest.approx(0.2) and r.cagr == pytest.approx(1.2 ** (365.25 / 6) - 1)
    assert r.share_up == pytest.approx(0.5) and r.best == pytest.approx(120 / 88 - 1)
    assert R.nav_report(spark.createDataFrame([], "trade_date date, nav double")).first().n == 0
    flat = R.nav_report(spark.createDataFrame([(day(i), 0.0) for i in range(4)], "trade_date date, nav double")).first()
    assert flat.total is None and flat.sharpe is None


def test_horizons_leave_out_what_is_not_finite(spark):
    rows = [(day(i % 2), float(i), [float(i), None, float("nan"), -float(i)][i % 4], 1.0) for i in range(12)]
    long = R.by_horizon(spark.createDataFrame(rows, "trade_date date, p double, a double, b double"), {1: ("p", "a"), 5: ("p", "b")})
    got = {r.horizon: r for r in R.horizon_metrics(long).collect()}
    assert got[1].n == 6 and got[5].n == 12 and got[5].ic is None
    assert got[1].mae == pytest.approx(sum(2 * i for i in range(12) if i % 4 == 3) / 6)
    assert R.daily_ic(long, ["horizon"], 3).where("horizon = 5").count() == 0


def test_bins_of_few_values(spark):
    df = spark.createDataFrame([("d", float(i % 2), float(i)) for i in range(10)] + [("d", None, 1.0), ("e", 1.0, None)], "g string, p double, y double")
    got = R.bin_report(df, "p", "y", ["g"], 10).collect()
    assert sum(r.n for r in got) == 10 and len({r.spread for r in got}) == 1


def test_features_of_short_and_constant_series(spark):
    shape = "ts_code string, trade_date date, open double, high double, low double, close double, pre_close double, pct_chg double, vol long, amount double"
    rows = [("flat", day(i), 5.0, 5.0, 5.0, 5.0, 5.0, 0.0, 0, 0.0) for i in range(70)] + [("one", day(0), 5.0, 6.0, 4.0, 5.5, 5.0, 10.0, 3, 9.0)]
    got = X.feature_set(spark.createDataFrame(rows, shape).repartition(3)).collect()
    assert len(got) == 71
    last = max((r for r in got if r.ts_code == "flat"), key=lambda r: r.trade_date)
    assert last.close_ma_60_ratio == 1 and last.vol_ratio_5 is None and last.bbpct_20 is None and last.adx is None and last.rsi_guarded is None and last.limit_up_streak == 0 and last.m_top_20 == 0
    one = next(r for r in got if r.ts_code == "one")
    assert one.limit_up_streak == 1 and one.momentum_5 is None and one.limit_up_count_20 is None and one.macd == 0


def test_no_look_ahead(spark):
    shape = "ts_code string, trade_date date, open double, high double, low double, close double, pre_close double, pct_chg double, vol long, amount double"
    prices = [10 + (i * 37 % 11) / 3 for i in range(80)]
    rows = [("a", day(i), p, p + 1, p - 1, p + 0.3, prices[i - 1] if i else p, (i * 13 % 21) - 10.0, 100 + i, 1e3 + i) for i, p in enumerate(prices)]
    whole = {r.trade_date: r for r in X.feature_set(spark.createDataFrame(rows, shape)).collect()}
    part = {r.trade_date: r for r in X.feature_set(spark.createDataFrame(rows[:50], shape)).collect()}
    assert all(part[d] == whole[d] for d in part)
