"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(x: Column, digits: int = 4) -> Column:
    """Round half up by floor, the same in every engine; what 64 bits don't hold is whole already, infinite or not a number, and stays so."""
    scale = float(10**digits)
    units = x * F.lit(scale) + F.lit(0.5)
    return F.when(F.abs(units) >= 2.0**62, units).otherwise(F.floor(units)) / F.lit(scale)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the pairs without nulls; null where one side doesn't vary or there is no pair."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return safe_div(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def guarded(value: Column, counted: Column, least: int) -> Column:
    """``value`` where at least ``least`` observations are in its window, as rolling windows with a minimum do."""
    return F.when(counted >= least, value)


def board(code: Column) -> Column:
    """Board of an instrument by the first digits of its code."""
    return (
        F.when(code.startswith("688"), "STAR").when(code.startswith("300"), "ChiNext")
        .when(code.startswith("8") | code.startswith("4"), "BSE").otherwise("Main")
    )
