"""Causal windows per instrument.  All take and return DataFrames with (ts_code, trade_date).

One window specification serves all columns of an operator, so a plan has one
exchange on ts_code and one sort, and later operators on the same key reuse
them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import guarded, safe_div

KEY, TIME = "ts_code", "trade_date"


def series() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def last(k: int) -> WindowSpec:
    """The current row and the k - 1 before it."""
    return series().rowsBetween(-(k - 1), 0)


def before(k: int) -> WindowSpec:
    """The k rows strictly before the current one."""
    return series().rowsBetween(-k, -1)


def rolling(fn, x: str | Column, k: int, least: int | None = None, window: WindowSpec | None = None) -> Column:
    """``fn(x)`` over the last k rows, null until ``least`` (k) of them are not null."""
    x = F.col(x) if isinstance(x, str) else x
    w = last(k) if window is None else window
    return guarded(fn(x).over(w), F.count(x).over(w), k if least is None else least)


def returns(bars: DataFrame, price: str, lags: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Relative change, difference and log return over each lag."""
    w = series()
    out = {}
    for k in lags:
        past = F.lag(price, k).over(w)
        out |= {f"ret_{k}": safe_div(F.col(price), past) - 1, f"diff_{k}": F.col(price) - past, f"log_ret_{k}": F.ln(safe_div(F.col(price), past))}
    return bars.withColumns(out)


def streak(flag: Column, key: str = KEY, time: str = TIME) -> Column:
    """Length of the current run of true flags: rows since the last false one."""
    w = Window.partitionBy(key).orderBy(time)
    row = F.row_number().over(w)
    return row - F.coalesce(F.max(F.when(~F.coalesce(flag, F.lit(False)), row)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def with_streak(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """``df`` with the run length of ``flag``; two window passes over one sort."""
    w = series()
    marked = df.withColumn("_row", F.row_number().over(w)).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    stop = F.max(F.when(~F.col("_flag"), F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, (F.col("_row") - F.coalesce(stop, F.lit(0))).cast("int")).drop("_row", "_flag")


def rows_since(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Rows since ``flag`` was last true, 0 on such a row, null before the first."""
    w = series()
    marked = df.withColumn("_row", F.row_number().over(w))
    at = F.last(F.when(flag, F.col("_row")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, (F.col("_row") - at).cast("int")).drop("_row")


def true_range(high: Column, low: Column, pre_close: Column) -> Column:
    return F.greatest(high - low, F.abs(high - pre_close), F.abs(low - pre_close))


def fill_forward(df: DataFrame, *names: str) -> DataFrame:
    """Last value that isn't null; never from the future."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})


def ewm_mean(x: np.ndarray, alpha: float) -> np.ndarray:
    """Recursive mean y = (1 - alpha) y' + alpha x from the first value that isn't missing; missing values repeat y."""
    return pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with an exponential mean per spec {name: (column, alpha)}, by one Arrow pass per instrument.

    A recurrence: each instrument's series is one group, bounded by its dates.
    """
    added = "".join(f", {n} double" for n in specs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + added

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        for name, (column, alpha) in specs.items():
            pdf[name] = ewm_mean(pdf[column].to_numpy(float), alpha)
        return pdf

    return df.groupBy(KEY).applyInPandas(run, schema)


def macd(df: DataFrame, price: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``df`` with macd, macd_signal and macd_hist."""
    span = lambda n: 2.0 / (n + 1)
    added = ", macd double, macd_signal double, macd_hist double"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + added

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        x = pdf[price].to_numpy(float)
        line = ewm_mean(x, span(fast)) - ewm_mean(x, span(slow))
        pdf["macd"], pdf["macd_signal"] = line, ewm_mean(line, span(signal))
        pdf["macd_hist"] = pdf["macd"] - pdf["macd_signal"]
        return pdf

    return df.groupBy(KEY).applyInPandas(run, schema)


def wilder_rsi(df: DataFrame, price: str, period: int = 14, name: str = "rsi") -> DataFrame:
    """Relative strength index on Wilder's recursive means of gains and losses; 100 without losses."""
    d = F.col(price) - F.lag(price).over(series())
    parts = df.withColumns({"_gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    smooth = ewm(parts, {"_g": ("_gain", 1.0 / period), "_l": ("_loss", 1.0 / period)})
    rsi = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, 100.0)
    return smooth.withColumn(name, rsi).drop("_gain", "_loss", "_g", "_l")
