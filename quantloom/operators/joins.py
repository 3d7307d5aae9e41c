"""Point-in-time joins: as-of, as-of with a largest age, intervals, held days, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the order given, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, key: str, on: str, at: str, payload: list[str], max_age: int | None = None) -> DataFrame:
    """``left`` with the payload of the last right row of its key at or before its date, and that row's date as ``at``.

    ``right`` has one row per (key, at).  Both sides are one union, sorted
    once per key, so no pair is made; a matched null stays null because the
    payload travels as a struct.  ``max_age`` in days drops older matches.
    """
    body = F.struct(F.col(at).alias(at), *payload)
    names = left.columns
    stacked = left.withColumns({"_t": F.col(on), "_side": F.lit(1), "_right": F.lit(None).cast(right.select(body.alias("b")).schema["b"].dataType)})
    others = right.select(F.col(key), F.col(at).alias("_t"), F.lit(0).alias("_side"), body.alias("_right"))
    both = stacked.unionByName(others, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if max_age is not None:
        found = found.withColumn("_m", F.when(F.datediff(F.col(on), F.col(f"_m.{at}")) <= max_age, F.col("_m")))
    return found.select(*names, F.col(f"_m.{at}").alias(at), *[F.col(f"_m.{p}").alias(p) for p in payload])


def in_interval(left: DataFrame, intervals: DataFrame, key: str, on: str, start: str, end: str, flag: str) -> DataFrame:
    """``left`` with a flag: is the date inside some interval of its key, both ends included, open where the end is null?

    Intervals are turned into coverage by a running maximum of ends over the
    union of both sides, so overlapping intervals make no extra rows.
    """
    names = left.columns
    forever = F.to_date(F.lit("9999-12-31"))
    rows = left.withColumns({"_t": F.col(on), "_side": F.lit(1), "_end": F.lit(None).cast("date")})
    spans = intervals.select(F.col(key), F.col(start).alias("_t"), F.lit(0).alias("_side"), F.coalesce(end, forever).alias("_end"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    reach = rows.unionByName(spans, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(w)).where("_side = 1")
    return reach.withColumn(flag, F.coalesce(F.col("_reach") >= F.col(on), F.lit(False))).select(*names, flag)


def held_days(trades: DataFrame, calendar: DataFrame, entry: str = "entry_date", exit_: str = "exit_date", day: str = "trade_date") -> DataFrame:
    """One row per trade and day held, entry included, exit not: each trade lists its days, which meet the calendar by equality."""
    days = trades.where(F.col(entry) < F.col(exit_)).withColumn(day, F.explode(F.sequence(F.col(entry), F.date_sub(F.col(exit_), 1))))
    return days.join(calendar.select(day).distinct(), day)
