"""Bars of a day's trading rolled up to what a daily model reads of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded, safe_div


def tick_bars(ticks: DataFrame, key: str, at: str, every: str, price: str, taker: Column, order: list[str]) -> DataFrame:
    """(key, at, open, high, low, close, volume, taker_buy) per interval that has ticks; ticks of one moment stand in ``order``."""
    moment = F.struct(at, *order)
    bars = ticks.where(F.col(price).isNotNull()).groupBy(key, F.window(at, every)["start"].alias("_at")).agg(
        F.min_by(price, moment).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, moment).alias("close"), F.count("*").cast("double").alias("volume"), F.sum(taker.cast("double")).alias("taker_buy")
    )
    return bars.withColumnRenamed("_at", at)


def daily_microstructure(bars: DataFrame, key: str, at: str, lookback: int = 288, least: int = 50, jump: float = 4.0) -> DataFrame:
    """(key, day) with realised and bipower variation, jumps, semivariances, shape, range, flow and concentration of each day's bars.

    Returns are logs over the bar before, across days; the first of a key has
    none.  A jump is a return of more than ``jump`` times the median size of the last ``lookback`` returns, of which ``least``
    must be there.  Skew and kurtosis are corrected for bias and null where too few
    returns, or none that differ, are left; shares without a divisor are null.
    """
    w = Window.partitionBy(key).orderBy(at)
    r = F.ln(safe_div(F.col("close"), F.lag("close").over(w)))
    rows = bars.withColumns({"_r": r, "_day": F.to_date(at)}).withColumn("_a", F.abs("_r"))
    recent = w.rowsBetween(-(lookback - 1), 0)
    median = guarded(F.percentile("_a", F.lit(0.5)).over(recent), F.count("_a").over(recent), least)
    rows = rows.withColumns({"_bp": F.col("_a") * F.lag("_a").over(w), "_jump": F.coalesce((F.col("_a") > jump * median).cast("int"), F.lit(0))})
    square, up, down = F.col("_r") * F.col("_r"), F.when(F.col("_r") > 0, F.col("_r")).otherwise(0.0), F.when(F.col("_r") < 0, F.col("_r")).otherwise(0.0)
    d = rows.groupBy(key, F.col("_day").alias("day")).agg(
        F.count("_r").alias("n"), F.coalesce(F.sum(square), F.lit(0.0)).alias("rv2"), (F.coalesce(F.sum("_bp"), F.lit(0.0)) * (math.pi / 2)).alias("bp2"), F.sum(up * up).alias("up2"), F.sum(down * down).alias("down2"),
        F.skewness("_r").alias("g1"), F.kurtosis("_r").alias("g2"), F.sum("_jump").alias("jump_count"), F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("open", at).alias("open"), F.max_by("close", at).alias("close"),
        F.max("close").alias("top"), F.min("close").alias("bottom"), F.sum("volume").alias("volume"), F.sum("taker_buy").alias("buy"), F.sum(F.col("volume") * F.col("volume")).alias("v2"), F.count("*").alias("bars"),
    )
    n, span = F.col("n").cast("double"), F.col("high") - F.col("low")
    varied = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return d.select(
        key, "day", "bars", F.sqrt("rv2").alias("rv"), F.sqrt("bp2").alias("bipower"), F.sqrt(F.greatest(F.col("rv2") - F.col("bp2"), F.lit(0.0))).alias("jump"), F.sqrt("up2").alias("rv_up"), F.sqrt("down2").alias("rv_down"),
        safe_div(F.col("up2") - F.col("down2"), F.col("rv2")).alias("semi_skew"), "jump_count", F.when((n > 2) & varied("g1"), F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("g1")).alias("skew"),
        F.when((n > 3) & varied("g2"), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6)).alias("kurt"), safe_div(span, F.col("open")).alias("range_pct"), safe_div(F.abs(F.col("close") - F.col("open")), span).alias("efficiency"),
        safe_div(F.col("buy"), F.col("volume")).alias("taker_ratio"), safe_div(2 * F.col("buy") - F.col("volume"), F.col("volume")).alias("imbalance"), (safe_div(F.col("top"), F.col("open")) - 1).alias("drawup"), (safe_div(F.col("bottom"), F.col("open")) - 1).alias("drawdown"),
        safe_div(F.col("v2") * F.col("bars"), F.col("volume") * F.col("volume")).alias("concentration"),
    )
