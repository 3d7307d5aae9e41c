"""Market regimes: blocks of days above or below a moving average, short ones merged, dealt to splits with purged borders."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raw_blocks(days: DataFrame, bull: Column, key: str, day: str = "trade_date") -> DataFrame:
    """(key, block, regime, first_day, last_day, n_days): islands of days of one regime, numbered in order."""
    w = Window.partitionBy(key).orderBy(day)
    regime = F.when(F.coalesce(bull, F.lit(False)), "bull").otherwise("bear")
    turned = days.withColumn("regime", regime).withColumn("_new", (F.lag("regime").over(w).isNull() | (F.lag("regime").over(w) != F.col("regime"))).cast("int"))
    marked = turned.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy(key, "block").agg(F.first("regime").alias("regime"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").cast("int").alias("n_days"))


def merged(blocks: list[tuple[str, object, object, int]], least: int) -> list[tuple[str, object, object, int]]:
    """Blocks (regime, first, last, days) merged until none is shorter than ``least``.

    The shortest goes first, the earlier of equals; it takes the regime of its
    smaller neighbour, the earlier of equals, and blocks of one regime that then touch are one.  A
    chain of neighbours and a heap of lengths make it one step per merge.
    """
    n = len(blocks)
    regime, first, last, size = ([b[k] for b in blocks] for k in range(4))
    before, after, alive = [i - 1 for i in range(n)], [i + 1 if i + 1 < n else -1 for i in range(n)], [True] * n
    heap = [(size[i], i) for i in range(n) if size[i] < least]
    heapq.heapify(heap)

    def unite(left: int, right: int) -> None:
        """The right block becomes part of the left one."""
        last[left], size[left], alive[right] = last[right], size[left] + size[right], False
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left

    while heap:
        days, i = heapq.heappop(heap)
        if not alive[i] or size[i] != days:
            continue
        p, q = before[i], after[i]
        if p < 0 and q < 0:
            break
        other = p if q < 0 or (p >= 0 and size[p] <= size[q]) else q
        left, right = (other, i) if other == p else (i, other)
        regime[left] = regime[other]
        unite(left, right)
        while before[left] >= 0 and regime[before[left]] == regime[left]:
            unite(before[left], left)
            left = before[left]
        while after[left] >= 0 and regime[after[left]] == regime[left]:
            unite(left, after[left])
        if size[left] < least:
            heapq.heappush(heap, (size[left], left))
    return [(regime[i], first[i], last[i], size[i]) for i in range(n) if alive[i]]


def merge_short(blocks: DataFrame, key: str, least: int = 40) -> DataFrame:
    """``blocks`` of each series with the short ones merged; one series is one group, of a few hundred rows in a century."""
    shape = f"{key} {blocks.schema[key].dataType.simpleString()}, block int, regime string, first_day date, last_day date, n_days int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        rows = merged(list(zip(pdf["regime"], pdf["first_day"], pdf["last_day"], pdf["n_days"].astype(int), strict=True)), least)
        return pd.DataFrame([(pdf[key].iloc[0], k + 1, *r) for k, r in enumerate(rows)], columns=[key, "block", "regime", "first_day", "last_day", "n_days"])

    return blocks.groupBy(key).applyInPandas(one, shape)


def assign(blocks: DataFrame, key: str, val_days: int = 200, test_days: int = 190) -> DataFrame:
    """``blocks`` with ``split`` and ``tail``: the split of their last ``tail`` days; days before are train.

    Validation is the end of the longest bear block (the earlier of equals;
    without one, of the last but one), test the end of the last block if that isn't it.
    """
    w = Window.partitionBy(key)
    bears = F.max(F.when(F.col("regime") == "bear", F.struct(F.col("n_days").alias("n"), (-F.col("block")).alias("b")))).over(w)
    count = F.count(F.lit(1)).over(w)
    val = F.coalesce(-bears["b"], F.greatest(F.lit(1), count - 1))
    marked = blocks.withColumns({"_val": val, "_last": count})
    split = F.when(F.col("block") == F.col("_val"), "val").when(F.col("block") == F.col("_last"), "test").otherwise("train")
    tail = F.when(split == "val", F.least(F.lit(val_days), F.col("n_days"))).when(split == "test", F.least(F.lit(test_days), F.col("n_days"))).otherwise(F.col("n_days"))
    return marked.withColumns({"split": split, "tail": tail.cast("int")}).drop("_val", "_last")


def split_days(days: DataFrame, blocks: DataFrame, key: str, purge: int = 35, day: str = "trade_date") -> DataFrame:
    """(key, day, split): each day's split by its block; the last ``purge`` days before every change of split are ``gap``.

    A day meets its block by the number of blocks that have begun: one union
    and running values over one exchange, no range join.  Gaps come from the next change ahead of a day, by
    number of day, which is carried from the last day backwards: a frame from each day to the end would be added up anew for every day.
    """
    starts = blocks.select(key, F.col("first_day").alias(day), F.lit(0).alias("_side"), F.struct("block", "split", "tail", "n_days").alias("_b"))
    stacked = days.select(key, day, F.lit(1).alias("_side"), F.lit(None).cast(starts.schema["_b"].dataType).alias("_b"))
    w = Window.partitionBy(key).orderBy(day, "_side")
    met = starts.unionByName(stacked).withColumn("_b", F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    once = met.withColumn("_k", F.row_number().over(Window.partitionBy(key, day).orderBy("_side"))).where("_k = 1")
    o = Window.partitionBy(key).orderBy(day)
    numbered = once.withColumns({"_row": F.row_number().over(o), "_begins": ~F.lag("_b.block").over(o).eqNullSafe(F.col("_b.block"))})
    at = F.col("_row") - F.last(F.when(F.col("_begins"), F.col("_row")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)) + 1
    placed = numbered.withColumn("raw", F.when(F.col("_b").isNull() | (at <= F.col("_b.n_days") - F.col("_b.tail")), "train").otherwise(F.col("_b.split")))
    turned = placed.withColumn("_turn", F.lead("raw").over(o) != F.col("raw"))
    back = Window.partitionBy(key).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last(F.when(F.col("_turn"), F.col("_row")), ignorenulls=True).over(back)
    gap = F.coalesce(ahead - F.col("_row") < purge, F.lit(False))
    return turned.select(key, day, F.when(gap, "gap").otherwise(F.col("raw")).alias("split"))
