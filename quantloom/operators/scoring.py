"""Scores of instruments from several views of their series, and of factors from their returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .timeseries import KEY, TIME, rolling, series

#: Points of the trend's five comparisons, the ADX from which a trend is strong, and what each state counts.
POINTS = {"price_20": 1, "price_50": 1, "price_200": 2, "mean_20_50": 1, "mean_50_200": 2}
STRONG = 25.0
STATES = {"strong_uptrend": 1.0, "uptrend": 0.7, "neutral": 0.3, "downtrend": 0.0, "strong_downtrend": -0.5}
#: Shares of momentum, trend, patterns and liquidity in a total.
SHARES = (0.4, 0.3, 0.2, 0.1)


def trend(bars: DataFrame, adx: str = "adx", least: int = 200) -> DataFrame:
    """``bars`` with ``trend_points`` (0 to 7) and ``trend_state``; neutral before ``least`` bars.

    The close against its means of 20, 50 and 200 bars, and the means against each other; ``adx``
    makes an extreme state strong.
    """
    means = {f"_m{k}": rolling(F.avg, "close", k) for k in (20, 50, 200)}
    rows = bars.withColumns({**means, "_n": F.row_number().over(series())})
    tests = {"price_20": F.col("close") > F.col("_m20"), "price_50": F.col("close") > F.col("_m50"), "price_200": F.col("close") > F.col("_m200"), "mean_20_50": F.col("_m20") > F.col("_m50"), "mean_50_200": F.col("_m50") > F.col("_m200")}
    points = reduce(lambda a, b: a + b, [F.when(F.coalesce(t, F.lit(False)), POINTS[n]).otherwise(0) for n, t in tests.items()])
    p, strong = F.col("trend_points"), F.coalesce(F.col(adx) > STRONG, F.lit(False))
    state = (
        F.when(F.col("_n") < least, "neutral").when((p >= 6) & strong, "strong_uptrend").when(p >= 4, "uptrend").when((p <= 1) & strong, "strong_downtrend").when(p <= 2, "downtrend").otherwise("neutral")
    )
    return rows.withColumn("trend_points", points).withColumn("trend_state", state).drop("_n", *means)


def state_score(state: Column) -> Column:
    return reduce(lambda acc, s: F.when(state == s[0], s[1]).otherwise(acc), STATES.items(), F.lit(0.0))


def momentum(k: int = 252, skip: int = 21) -> Column:
    """Change from ``k`` bars back to ``skip`` bars back, over the deviation of the daily changes between, which spans a root of that many bars."""
    w = series()
    then, now = F.lag("close", k - 1).over(w), F.lag("close", skip).over(w)
    change = safe_div(now, then) - 1
    between = w.rowsBetween(-(k - 2), -skip)
    return safe_div(change, F.stddev_samp("_change").over(between) * F.sqrt(F.lit(float(k - 1 - skip))))


def composite(bars: DataFrame, pattern: Column, liquid: float, least: int = 252) -> DataFrame:
    """One row per instrument, its last bar: momentum, trend, pattern and liquidity scores, their total, and its place among those in an uptrend.

    ``bars`` have ``adx``; ``pattern`` is a score of the bar.  Instruments of fewer than ``least`` bars, or whose
    mean amount of 20 bars is under ``liquid``, are left out; those without positive momentum or an
    uptrend have no place.
    """
    w = series()
    rows = trend(bars.withColumn("_change", safe_div(F.col("close"), F.lag("close").over(w)) - 1))
    rows = rows.withColumns({"momentum": momentum(), "_amount": rolling(F.avg, "amount", 20), "_n": F.row_number().over(w), "pattern": pattern, "_back": F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))})
    last = rows.where((F.col("_back") == 1) & (F.col("_n") >= least) & (F.col("_amount") >= liquid))
    parts = [F.col("momentum"), state_score(F.col("trend_state")), F.col("pattern"), F.least(F.col("_amount") / F.lit(liquid) / 10, F.lit(1.0))]
    total = reduce(lambda a, b: a + b, [p * s for p, s in zip(parts, SHARES, strict=True)])
    scored = last.select(KEY, TIME, "momentum", "trend_state", parts[1].alias("trend"), "pattern", parts[3].alias("liquidity"), total.alias("total"))
    good = F.coalesce((F.col("momentum") > 0) & F.col("trend_state").isin("uptrend", "strong_uptrend"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("_good").orderBy(F.desc("total"), KEY))
    return scored.withColumn("_good", good).withColumn("place", F.when(F.col("_good"), place)).drop("_good")


def trajectory(columns: list[str]) -> dict[str, Column]:
    """Mean, largest and least-squares slope of forecasts for horizons 1 to n; null where one is missing."""
    n = len(columns)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    centre, square = (n + 1) / 2, sum((h - (n + 1) / 2) ** 2 for h in range(1, n + 1))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    slope = reduce(lambda a, b: a + b, [F.col(c) * ((h - centre) / square) for h, c in enumerate(columns, 1)])
    return {"mean": F.when(whole, total / n), "top": F.when(whole, F.greatest(*columns)), "slope": F.when(whole, slope)}


def stability(importances: DataFrame, top: int) -> DataFrame:
    """(feature, refits, mean, std, top_count, top_share) of (refit, feature, importance): the population deviation, and how often among the first ``top``."""
    w = Window.partitionBy("refit").orderBy(F.desc("importance"), "feature")
    ranked = importances.withColumn("_top", (F.row_number().over(w) <= top).cast("int"))
    return ranked.groupBy("feature").agg(F.count("*").alias("refits"), F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.sum("_top").alias("top_count"), F.avg("_top").alias("top_share"))


def attribution(exposures: DataFrame, returns: DataFrame, curve: DataFrame, factors: list[str], day: str = "trade_date") -> DataFrame:
    """Per day of the curve: each factor's contribution, alpha, and all of them compounded (``cum_``).

    A contribution is yesterday's exposure times today's factor return (in
    per cent) times the invested share of the curve's value, held between 0 and 1.  Exposures and
    returns stand until the next.  Alpha is what the contributions leave of the curve's own return; days without
    one count 0.  All tables have one row per day.
    """
    o = Window.orderBy(day)
    past = o.rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda df, tag: df.select(day, *[F.col(f).alias(f"_{tag}_{f}") for f in factors])
    # The days of all three, so that a value of a day without a curve stands for the next one that has it.
    days = curve.select(day, "nav", "invested", F.lit(True).alias("_own")).join(wide(exposures, "e"), day, "full").join(wide(returns, "r"), day, "full")
    held = days.withColumns({f"_{t}_{f}": F.last(f"_{t}_{f}", ignorenulls=True).over(past) for t in ("e", "r") for f in factors}).where("_own")
    share = F.greatest(F.least(safe_div(F.col("invested"), F.col("nav")), F.lit(1.0)), F.lit(0.0))
    own = safe_div(F.col("nav"), F.lag("nav").over(o)) - 1
    made = held.withColumns({f: F.coalesce(F.lag(f"_e_{f}").over(o) * F.col(f"_r_{f}") / 100 * share, F.lit(0.0)) for f in factors}).withColumn("_own_ret", own)
    explained = reduce(lambda a, b: a + b, [F.col(f) for f in factors])
    full = made.withColumn("alpha", F.coalesce(F.col("_own_ret") - explained, F.lit(0.0)))
    grown = lambda c: F.exp(F.sum(F.ln(1 + F.coalesce(c, F.lit(0.0)))).over(past)) - 1
    return full.withColumns({f"cum_{c}": grown(F.col(c)) for c in (*factors, "alpha")} | {"cum_total": grown(F.col("_own_ret"))}).select(day, *factors, "alpha", *[f"cum_{c}" for c in (*factors, "alpha", "total")])
