"""Ranks, bins and normalisation across the instruments of a date (or of any group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation


def average_rank(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Average rank of ties from 1, null for null: the smallest rank plus half of the other ties."""
    w, ties = Window.partitionBy(*by, F.col(column).isNull()).orderBy(column), Window.partitionBy(*by, column)
    ranked = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return df.withColumn(name, F.when(F.col(column).isNotNull(), ranked))


def percent_rank(df: DataFrame, column: str, by: list[str], name: str, fill: float = 0.5) -> DataFrame:
    """Average rank over the count of values; null gets ``fill``."""
    ranked = average_rank(df, column, by, "_rank")
    return ranked.withColumn(name, F.coalesce(F.col("_rank") / F.count(column).over(Window.partitionBy(*by)), F.lit(fill))).drop("_rank")


def bin_of(x: Column, edges: Column) -> Column:
    """Index from 0 of the right-closed bin of x, the lowest edge included."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x)))


def quantile_bins(df: DataFrame, column: str, by: list[str], bins: int, name: str) -> DataFrame:
    """Quantile bins with linearly interpolated edges, right-closed, equal edges dropped; null for null.

    The edges of a group come from one aggregation, joined back by its key.
    """
    shares = [i / bins for i in range(bins + 1)]
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(s) for s in shares]))).alias("_edges"))
    joined = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn(name, bin_of(F.col(column), F.col("_edges"))).drop("_edges")


def winsor_zscore(df: DataFrame, column: str, by: list[str], name: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the group's quantiles, then (x - mean) / sample deviation; 0 where the deviation is 0."""
    bounds = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_b"))
    clipped = df.join(bounds, by).withColumn("_x", F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("_b")[0]), F.col("_b")[1])))
    w = Window.partitionBy(*by)
    sd = F.stddev_samp("_x").over(w)
    z = F.when(F.col("_x").isNull(), F.lit(None)).when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col("_x") - F.avg("_x").over(w)) / sd)
    return clipped.withColumn(name, z).drop("_b", "_x")


def rank_ic(df: DataFrame, x: str, y: str, by: list[str], least: int) -> DataFrame:
    """Spearman correlation of x and y per group with at least ``least`` pairs; no row where one side doesn't vary."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(pairs, x, by, "_rx"), y, by, "_ry")
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("ic"), (F.min("_rx") < F.max("_rx")).alias("_vx"), (F.min("_ry") < F.max("_ry")).alias("_vy"))
    return out.where((F.col("n") >= least) & F.col("_vx") & F.col("_vy")).drop("_vx", "_vy")
