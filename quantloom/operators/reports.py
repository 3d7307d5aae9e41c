"""Reports of forecasts and portfolios: accuracy per day, horizon and bin, growth and risk of a curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, safe_div
from ..streaming.jobs import kept
from .cross_section import quantile_bins, rank_ic
from .ensembles import pair
from .ordering import average_ranks


def by_horizon(df: DataFrame, horizons: dict[int, tuple[str, str]], day: str = "trade_date") -> DataFrame:
    """(horizon, day, pred, target): one row per bar and horizon, of the finite pairs."""
    structs = [F.struct(F.lit(h).alias("horizon"), F.col(p).cast("double").alias("pred"), F.col(t).cast("double").alias("target")) for h, (p, t) in horizons.items()]
    long = df.select(day, F.explode(F.array(*structs)).alias("h")).select("h.horizon", day, "h.pred", "h.target")
    return long.where(pair(F.col("pred"), F.col("target")))


def horizon_metrics(rows: DataFrame, by: str = "horizon") -> DataFrame:
    """(horizon, n, ic, mae, rmse, hit_rate): ranks of the whole sample, absolute and squared errors, equal signs.

    Horizons are few and large: values are counted and ranked over all tasks, no task sorts a horizon.
    """
    e = F.col("pred") - F.col("target")
    rows = kept(rows)
    ranked = average_ranks(average_ranks(rows, "pred", [by], "_p"), "target", [by], "_t")
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"), correlation("_p", "_t").alias("ic"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((F.signum("pred") == F.signum("target")).cast("int")).alias("hit_rate"),
    )


def daily_ic(rows: DataFrame, by: list[str], least: int = 10, day: str = "trade_date") -> DataFrame:
    """(by, day, n, ic): rank correlation of pred and target per day; days of fewer pairs than ``least``, or without variation, are left out."""
    return rank_ic(rows.where(pair(F.col("pred"), F.col("target"))), "pred", "target", [*by, day], least)


def ic_summary(ics: DataFrame, by: list[str]) -> DataFrame:
    """(by, days, mean, std, icir, share_positive) of daily correlations."""
    return ics.groupBy(*by).agg(
        F.count("ic").alias("days"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), safe_div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg((F.col("ic") > 0).cast("int")).alias("share_positive"),
    )


def bin_report(df: DataFrame, prediction: str, target: str, by: list[str], bins: int = 10) -> DataFrame:
    """(bin, n, mean, std, spread): targets by quantile bins of each group's predictions; spread is the top bin's mean over the bottom's."""
    rows = df.where(pair(F.col(prediction), F.col(target)))
    found = quantile_bins(rows, prediction, by, bins, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
    w = Window.partitionBy()
    return found.withColumn("spread", F.max_by("mean", "bin").over(w) - F.min_by("mean", "bin").over(w))


def nav_report(curve: DataFrame, day: str = "trade_date", nav: str = "nav", rf: float = 0.0) -> DataFrame:
    """One row on a curve of one value a day: growth by calendar and by bars, risk, ratios, the deepest drawdown with its days.

    Deviations are of simple returns, sample ones, times the root of 252;
    ``sortino`` divides by the root mean square of losses.  The peak is the first day of the high before
    the trough, the trough the first day of the deepest value.  Ratios without a
    divisor are null, and all figures but the count of a curve of one day.
    """
    w = Window.orderBy(day)
    top = F.max(F.struct(F.col(nav).alias("v"), (-F.unix_date(day)).alias("d"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.select(F.col(day).alias("_d"), F.col(nav).cast("double").alias("_v"), (safe_div(F.col(nav), F.lag(nav).over(w)) - 1).alias("r"), top.alias("_top")).withColumn("_dd", safe_div(F.col("_v"), F.col("_top.v")) - 1)
    worst = F.min(F.struct("_dd", "_d", F.date_from_unix_date(-F.col("_top.d")).alias("p")))
    loss = F.when(F.col("r") < 0, F.col("r") * F.col("r")).when(F.col("r").isNotNull(), 0.0)
    a = rows.agg(
        F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(loss)).alias("down"), F.min_by("_v", "_d").alias("a"), F.max_by("_v", "_d").alias("z"),
        F.datediff(F.max("_d"), F.min("_d")).alias("days"), F.max("r").alias("best"), F.min("r").alias("worst"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("int"))).alias("share_up"), worst.alias("x"),
    )
    grown, year = safe_div(F.col("z"), F.col("a")), F.sqrt(F.lit(252.0))
    return a.select(
        "n", (grown - 1).alias("total"), (F.pow(grown, safe_div(F.lit(365.25), F.col("days"))) - 1).alias("cagr"), (F.pow(grown, safe_div(F.lit(252.0), F.col("n"))) - 1).alias("cagr_bars"),
        (F.col("sd") * year).alias("vol"), (safe_div(F.col("m"), F.col("sd")) * year).alias("sharpe"), (safe_div(F.col("m") - rf / 252, F.col("sd")) * year).alias("sharpe_rf"),
        (safe_div(F.col("m"), F.col("down")) * year).alias("sortino"), F.col("x._dd").alias("max_drawdown"), F.col("x.p").alias("peak"), F.col("x._d").alias("trough"), "best", "worst", "share_up",
    )
