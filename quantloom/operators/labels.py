"""Targets, label buckets and date splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import series


def forward_returns(bars: DataFrame, column: str, horizons: tuple[int, ...]) -> DataFrame:
    """The single-day value h rows ahead, per horizon."""
    return bars.withColumns({f"target_d{h}": F.lead(column, h).over(series()) for h in horizons})


def bucket(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bucket [lower, upper) of x; outer buckets are open-ended."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return F.when(x.isNotNull(), out)


def day_index(days: DataFrame, day: str = "trade_date") -> DataFrame:
    """Distinct days numbered from 0; one row per day, so the global order is small."""
    return days.select(day).distinct().withColumn("day_no", (F.row_number().over(Window.orderBy(day)) - 1).cast("int"))


def walk_forward(days: DataFrame, train: int, purge: int, val: int, embargo: int, test: int, horizon: int) -> DataFrame:
    """(fold, split, trade_date) of purged folds: train, gap, val, gap, test, advancing by ``test`` days.

    The gaps must cover the label's horizon.  Each day joins the few folds
    that can hold it, found by arithmetic, not by a range join.
    """
    if purge < horizon or embargo < horizon:
        raise ValueError("purge and embargo must be at least the horizon")
    total = train + purge + val + embargo + test
    numbered = day_index(days)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    folds = numbered.withColumn("n", n).withColumn("last_fold", F.floor((F.col("n") - total) / test).cast("int"))
    low = F.greatest(F.lit(0), F.ceil((F.col("day_no") - total + 1) / test).cast("int"))
    high = F.least(F.col("last_fold"), F.floor(F.col("day_no") / test).cast("int"))
    spread = folds.where((F.col("last_fold") >= 0) & (low <= high)).withColumn("fold", F.explode(F.sequence(low, high)))
    at = F.col("day_no") - F.col("fold") * test
    split = (
        F.when(at < train, "train").when(at < train + purge, "gap").when(at < train + purge + val, "val")
        .when(at < train + purge + val + embargo, "gap").otherwise("test")
    )
    return spread.select("fold", split.alias("split"), "trade_date")


def temporal_split(days: DataFrame, train: float = 0.7, val: float = 0.15, purge: int = 5) -> DataFrame:
    """(trade_date, split) by share of days, with a gap of ``purge`` days at the end of train and val."""
    d = day_index(days).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + val))
    i = F.col("day_no")
    return d.select("trade_date", F.when(i < a - purge, "train").when(i < a, "gap").when(i < b - purge, "val").when(i < b, "gap").otherwise("test").alias("split"))


def rolling_months(days: DataFrame, train: int, val: int, test: int, step: int, holdout: str, purge: int, day: str = "trade_date") -> DataFrame:
    """(day, split) of windows of months that advance by ``step``: test wins over val, val over train.

    A fold begins at the first of the first day's month, one more every ``step``
    months, as long as its test part ends by ``holdout``; from there on all days are test.  The
    ``purge`` days before each val part and before the hold-out (or the end, if it lies beyond) turn from train to ``gap``.  A day lists the
    folds whose parts can hold it, by counting months; no range join.
    """
    numbered = day_index(days, day)
    w = Window.partitionBy()
    limit, month = F.to_date(F.lit(holdout)), lambda c: F.year(c) * 12 + F.month(c)
    start = month(F.min(day).over(w))
    # The last fold's test part ends by the hold-out: a first of a month at or before it.
    rows = numbered.withColumn("_m", month(F.col(day)) - start).withColumn("_last", F.floor((month(limit) - start - train - val - test) / step))

    def inside(low: int, high: int) -> Column:
        """Whether some fold has its months low to high, exclusive, after its begin, around the day."""
        first = F.greatest(F.lit(0), F.ceil((F.col("_m") - high + 1) / step))
        return first <= F.least(F.col("_last"), F.floor((F.col("_m") - low) / step))

    late = F.col(day) >= limit
    split = F.when(late, "test").when(inside(train + val, train + val + test), "test").when(inside(train, train + val), "val").otherwise("train")
    # Borders: the first day at or after the begin of each val part, and of the hold-out.
    begun = F.when(F.col("_last") >= 0, F.least(F.col("_last"), F.floor((F.col("_m") - train) / step)))
    o = Window.orderBy(day)
    marked = rows.withColumns({"_split": split, "_begun": F.greatest(begun, F.lit(-1)), "_late": late.cast("int")})
    before = F.lag("_begun", 1, -1).over(o)
    border = (F.col("_begun") > before) | ((F.col("_late") == 1) & (F.lag("_late", 1, 0).over(o) == 0))
    ahead = F.first(F.when(F.col("_border"), F.col("day_no")), ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(ahead, F.count(F.lit(1)).over(w)) - F.col("day_no") <= purge
    return marked.withColumn("_border", border).select(day, F.when((F.col("_split") == "train") & near, "gap").otherwise(F.col("_split")).alias("split"))


def interleaved(days: DataFrame, months: tuple[int, ...], test_start: str, purge: int, day: str = "trade_date") -> DataFrame:
    """(day, split): the given months of every year are val, days from ``test_start`` on test, the others train.

    ``purge`` days of train before and after each val part and before test (or the end, if it lies beyond) are ``gap``.
    """
    numbered = day_index(days, day)
    late = F.col(day) >= F.to_date(F.lit(test_start))
    split = F.when(late, "test").when(F.month(day).isin(*months), "val").otherwise("train")
    o = Window.orderBy(day)
    marked = numbered.withColumn("_split", split)
    other = F.when(F.col("_split") != "train", F.col("day_no"))
    val = F.when(F.col("_split") == "val", F.col("day_no"))
    ahead, behind = F.first(other, ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing)), F.last(val, ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    end = F.count(F.lit(1)).over(Window.partitionBy())
    near = (F.coalesce(ahead, end) - F.col("day_no") <= purge) | F.coalesce(F.col("day_no") - behind <= purge, F.lit(False))
    return marked.select(day, F.when((F.col("_split") == "train") & near, "gap").otherwise(F.col("_split")).alias("split"))
