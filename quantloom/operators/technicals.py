"""Whole sets of technical features of a panel of bars, and Wilder's recursive ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import guarded, safe_div
from . import patterns as P
from . import timeseries as S

#: Rows back of the lagged returns, and windows of momentum, means and deviations.
LAGS, MOMENTUM, MEANS, SPREADS = (1, 2, 3, 5, 10), (5, 10, 20, 60), (5, 10, 20, 60), (5, 20, 60)
#: Changes from which a bar counts as one at its limit, either way.
LIMIT = 9.7


def price_set(bars: DataFrame) -> DataFrame:
    """``bars`` with shape, lags, momentum, means, spreads, ranges, volume ratios, bands, true range, flow and limit features.

    One exchange and one sort by instrument serve all windows.  A feature is
    null until its window is full and where its divisor is 0.
    """
    w = S.series()
    body_top, body_low = F.greatest("close", "open"), F.least("close", "open")
    ratio = safe_div(F.col("close"), F.col("pre_close"))
    base = bars.withColumns({
        "oc_ratio": safe_div(F.col("close") - F.col("open"), F.col("pre_close")), "hl_ratio": safe_div(F.col("high") - F.col("low"), F.col("pre_close")),
        "uppershadow": safe_div(F.col("high") - body_top, F.col("pre_close")), "lowershadow": safe_div(body_low - F.col("low"), F.col("pre_close")),
        "overnight_gap": safe_div(F.col("open") - F.col("pre_close"), F.col("pre_close")), "log_ret": F.when(ratio == 0, float("-inf")).otherwise(F.ln(ratio)),
        "_hl": F.ln(safe_div(F.col("high"), F.col("low"))), "_tr": S.true_range(F.col("high"), F.col("low"), F.col("pre_close")), "_flow": F.nanvl(F.signum("pct_chg"), F.lit(0.0)) * F.col("vol"),
        "hit_up_limit": (F.col("pct_chg") >= LIMIT).cast("int"), "hit_down_limit": (F.col("pct_chg") <= -LIMIT).cast("int"),
    })
    means = {f"_ma_{k}": S.rolling(F.avg, "close", k) for k in MEANS}
    out: dict[str, Column] = {f"ret_lag_{k}": F.lag("pct_chg", k).over(w) for k in LAGS}
    out |= {f"momentum_{k}": S.rolling(F.sum, "log_ret", k) for k in MOMENTUM}
    out |= {f"close_ma_{k}_ratio": safe_div(F.col("close"), F.col(f"_ma_{k}")) for k in MEANS}
    out |= {f"ma_{k}_slope": safe_div(F.col(f"_ma_{k}") - F.lag(f"_ma_{k}", k).over(w), F.col(f"_ma_{k}")) for k in MEANS}
    out |= {f"vol_pct_{k}": S.rolling(F.stddev_samp, "pct_chg", k) for k in SPREADS}
    out |= {f"parkinson_{k}": S.rolling(F.avg, "_hl", k) for k in SPREADS}
    for k in (20, 60):
        high, low = S.rolling(F.max, "high", k), S.rolling(F.min, "low", k)
        out |= {f"dist_from_high_{k}": safe_div(F.col("close") - high, high), f"dist_from_low_{k}": safe_div(F.col("close") - low, low)}
    for k in (5, 20):
        out |= {f"vol_ratio_{k}": safe_div(F.col("vol"), S.rolling(F.avg, "vol", k)), f"amt_ratio_{k}": safe_div(F.col("amount"), S.rolling(F.avg, "amount", k)), f"obv_flow_ma{k}": S.rolling(F.avg, "_flow", k)}
    spread = S.rolling(F.stddev_samp, "close", 20)
    out |= {"bbpct_20": safe_div(F.col("close") - (F.col("_ma_20") - 2 * spread), 4 * spread), "atr_14_pct": safe_div(S.rolling(F.avg, "_tr", 14), F.col("close"))}
    # Flags are whole numbers, so counts of a window that isn't full are guarded like sums.
    out |= {f"limit_{side}_count_20": guarded(F.sum(f"hit_{side}_limit").over(S.last(20)), F.count(F.lit(1)).over(S.last(20)), 20) for side in ("up", "down")}
    out |= {f"limit_{side}_streak": S.streak(F.col(f"hit_{side}_limit") == 1).cast("int") for side in ("up", "down")}
    return base.withColumns(means).withColumns(out).drop("_hl", "_tr", "_flow", *means)


def with_shapes(bars: DataFrame) -> DataFrame:
    """``bars`` with W bottoms and M tops of 10 and 20 bars."""
    for name, window, top in (("w_bottom_10", 10, False), ("w_bottom_20", 20, False), ("m_top_10", 10, True), ("m_top_20", 20, True)):
        bars = P.with_pattern(bars, "close", window, name, top)
    return bars


WILDER = ("rsi_open", "rsi_guarded", "rsi_mean", "atr_wilder", "plus_di", "minus_di", "adx", "macd", "macd_signal", "macd_hist")


def recursive_set(bars: DataFrame, period: int = 14) -> DataFrame:
    """``bars`` with RSI in three definitions, Wilder's ATR, directional indices and ADX, and MACD with its histogram.

    ``rsi_open`` has no least number of changes and is 100 without losses, ``rsi_guarded`` needs ``period``
    changes and a loss, ``rsi_mean`` takes means of the last ``period`` changes.  One Arrow pass per
    instrument does all recursions; its series is bounded by its dates.
    """
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields), *(f"{c} double" for c in WILDER)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(S.TIME)
        high, low, close = (pdf[c].astype(float) for c in ("high", "low", "close"))
        mean = lambda x, a, least=0: x.ewm(alpha=a, adjust=False, ignore_na=True, min_periods=least).mean()
        change, before = close.diff(), close.shift()
        gain, loss = change.clip(lower=0), -change.clip(upper=0)
        share = lambda g, l: 100 - 100 / (1 + g / l.where(l != 0))  # noqa: E731, E741
        g, loss_mean = mean(gain, 1 / period), mean(loss, 1 / period)
        pdf["rsi_open"] = share(g, loss_mean).where(loss_mean != 0, np.where(g > 0, 100.0, np.nan))
        pdf["rsi_guarded"] = share(mean(gain, 1 / period, period), mean(loss, 1 / period, period))
        pdf["rsi_mean"] = share(gain.rolling(period).mean(), loss.rolling(period).mean())
        tr = pd.concat([high - low, (high - before).abs(), (low - before).abs()], axis=1).max(axis=1)
        pdf["atr_wilder"] = mean(tr, 1 / period, period)
        up, down = high.diff(), -low.diff()
        plus = up.where((up > down) & (up > 0), 0.0).where(up.notna())
        minus = down.where((down > up) & (down > 0), 0.0).where(down.notna())
        scale = mean(tr, 1 / period)
        scale = scale.where(scale != 0)
        pdf["plus_di"], pdf["minus_di"] = 100 * mean(plus, 1 / period) / scale, 100 * mean(minus, 1 / period) / scale
        total = pdf["plus_di"] + pdf["minus_di"]
        pdf["adx"] = mean(100 * (pdf["plus_di"] - pdf["minus_di"]).abs() / total.where(total != 0), 1 / period)
        line = mean(close, 2 / 13) - mean(close, 2 / 27)
        pdf["macd"], pdf["macd_signal"] = line, mean(line, 2 / 10)
        pdf["macd_hist"] = line - pdf["macd_signal"]
        return pdf

    found = bars.groupBy(S.KEY).applyInPandas(run, shape)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in WILDER})


def feature_set(bars: DataFrame) -> DataFrame:
    """All of it: what a tabular model reads of an instrument's bars."""
    return recursive_set(with_shapes(price_set(bars)))
