"""What is known of each instrument at a day: histories as arrays, features at the starts of quarters, windows of vectors, filled grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded, safe_div
from .timeseries import KEY, TIME, before, rolling, series


def histories(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The last row of each instrument with an array of the last ``k`` values of each column, oldest first, nulls kept.

    Rows are numbered from the end once, so that only ``k`` a series are gathered.
    """
    w = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    recent = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    # Structs keep nulls, which a list of values would drop.
    rows = F.array_sort(F.collect_list(F.struct(F.col(TIME), *columns)))
    gathered = recent.groupBy(KEY).agg(F.max(TIME).alias(TIME), rows.alias("_rows"))
    path = lambda c: F.transform("_rows", lambda r: r[c]).alias(f"{c}_path")
    return gathered.select(KEY, TIME, F.size("_rows").alias("n"), *map(path, columns))


def quarter_starts(bars: DataFrame) -> DataFrame:
    """One row per instrument and quarter, its first bar, with returns, drawdown, spread and turnover of the bars before it.

    Features span 20, 60 and 250 bars up to the day before; null until a window
    is full.  ``listed_bars`` counts the bars so far.
    """
    w = series()
    change = safe_div(F.col("close"), F.lag("close").over(w)) - 1
    rows = bars.withColumns({"_r": change, "_q": F.trunc(TIME, "quarter"), "listed_bars": F.row_number().over(w)})
    past = lambda k: F.lag("close", k).over(w)
    full = lambda x, k: guarded(x, F.count("close").over(before(k)), k)
    out: dict[str, Column] = {f"ret_{k}": safe_div(past(1), past(k + 1)) - 1 for k in (20, 60, 250)}
    out |= {f"drawdown_{k}": safe_div(past(1), full(F.max("close").over(before(k)), k)) - 1 for k in (60, 250)}
    out |= {"spread_60": full(F.stddev_samp("_r").over(before(60)), 60), "turnover_20": full(F.avg("amount").over(before(20)), 20)}
    out["_first"] = F.coalesce(F.lag("_q").over(w) != F.col("_q"), F.lit(True))
    return rows.withColumns(out).where("_first").select(KEY, TIME, F.col("_q").alias("quarter"), "listed_bars", *[c for c in out if c != "_first"])


def day_vectors(items: DataFrame, key: str, day: str, vector: str, width: int) -> DataFrame:
    """(key, day, vector, n): the element-wise mean of the vectors of a key and day; other lengths and null vectors are left out.

    Elements are rows for one partial aggregation, so a day of many items makes no long list.
    """
    good = items.where(F.col(vector).isNotNull() & (F.size(vector) == width))
    parts = good.select(key, day, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(key, day, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(key, day).agg(F.transform(rows, lambda r: r["_m"]).alias(vector), F.max("_n").alias("n"))


def vector_window(days: DataFrame, key: str, day: str, vector: str, width: int, k: int) -> DataFrame:
    """(key, day, window): the vectors of the ``k`` calendar days up to each day that has one, oldest first, zeros for days without."""
    zeros = F.array_repeat(F.lit(0.0), width)
    w = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-(k - 1), 0)
    near = days.withColumn("_near", F.collect_list(F.struct(F.col(day).alias("d"), F.col(vector).alias("v"))).over(w))
    held = F.map_from_entries(F.transform("_near", lambda s: F.struct(s["d"], s["v"])))
    slots = F.sequence(F.date_sub(day, k - 1), F.col(day))
    return near.select(key, day, F.transform(slots, lambda d: F.coalesce(F.try_element_at(held, d), zeros)).alias("window"))


def resampled(ticks: DataFrame, key: str, at: str, value: str, every: str, seconds: int) -> DataFrame:
    """(key, at, value, filled): means per interval on the whole grid between a key's first and last, the last mean standing in for empty ones.

    A key's grid is made by arithmetic from its first and last interval.
    """
    means = ticks.where(F.col(value).isNotNull()).groupBy(key, F.window(at, every)["start"].alias(at)).agg(F.avg(value).alias(value))
    spans = means.groupBy(key).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    grid = spans.select(key, F.explode(F.sequence("_a", "_b", F.expr(f"interval {seconds} seconds"))).alias(at))
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(means, [key, at], "left").select(key, at, F.last(value, ignorenulls=True).over(w).alias(value), F.col(value).isNull().alias("filled"))


def setups(bars: DataFrame, k: int = 20) -> DataFrame:
    """The last bar of each instrument with flags: breakout over the highest of ``k`` bars before, pullback to a rising mean, narrow range on low volume.

    Flags are false until their windows are full.
    """
    w = series()
    mean, past = rolling(F.avg, "close", k), F.lag("_mean", 5).over(w)
    rows = bars.withColumns({
        "_high": guarded(F.max("high").over(before(k)), F.count("high").over(before(k)), k), "_mean": mean, "_long": rolling(F.avg, "close", 3 * k),
        "_span": rolling(F.avg, F.col("high") - F.col("low"), 5), "_wide": rolling(F.avg, F.col("high") - F.col("low"), k), "_vol": rolling(F.avg, F.col("vol").cast("double"), k), "_n": F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME))),
    }).withColumn("_before", past)
    rising = F.col("_mean") > F.col("_before")
    flags = {
        "breakout": F.col("close") > F.col("_high"),
        "pullback": rising & (F.col("close") > F.col("_long")) & (F.abs(safe_div(F.col("close"), F.col("_mean")) - 1) < 0.02),
        "squeeze": (F.col("_span") < 0.6 * F.col("_wide")) & (F.col("vol") < F.col("_vol")),
    }
    return rows.where("_n = 1").select(KEY, TIME, "close", *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()])
