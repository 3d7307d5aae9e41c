"""Chart patterns: W bottoms and M tops from two halves of a window, double bottoms and tops from prominent extrema."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import KEY, TIME, series

TINY = 1e-10


def two_halves(price: str, window: int, name: str, top: bool = False, threshold: float = 0.02) -> dict[str, Column]:
    """Columns to add in turn with ``with_pattern``: a W bottom (or M top) in the ``window`` bars before the current one."""
    seg, left, right, middle = f"_{name}_seg", f"_{name}_l", f"_{name}_r", f"_{name}_m"
    s, half = F.col(seg), window // 2
    worst, best = (F.array_max, F.array_min) if top else (F.array_min, F.array_max)
    past = F.collect_list(price).over(series().rowsBetween(-window, -1))
    first, second = F.slice(s, 1, half), F.slice(s, half + 1, window - half)
    between = F.slice(s, F.col(left) + 1, F.col(right) - F.col(left))
    lo, hi = F.element_at(s, F.col(left)), F.element_at(s, F.col(right))
    mid, last = F.element_at(s, F.col(middle)), F.element_at(s, -1)
    alike = F.abs(lo - hi) / (lo + TINY) < threshold
    apart = (mid < lo * (1 - threshold)) & (mid < hi * (1 - threshold)) if top else (mid > lo * (1 + threshold)) & (mid > hi * (1 + threshold))
    beyond = (lambda x: last < x) if top else (lambda x: last > x)
    found = (F.col(left) < F.col(middle)) & (F.col(middle) < F.col(right)) & alike & apart
    signal = F.when(found & beyond(mid), 1.0).when(found & beyond((lo + mid) / 2), 0.5).otherwise(0.0)
    return {
        seg: F.when(F.count(F.lit(1)).over(series().rowsBetween(-window, -1)) == window, past),
        left: F.array_position(first, worst(first)).cast("int"),
        right: (F.array_position(second, worst(second)) + half).cast("int"),
        middle: (F.array_position(between, best(between)) + F.col(left)).cast("int"),
        name: F.when(F.size(F.coalesce(s, F.array().cast("array<double>"))) == window, signal).otherwise(0.0),
    }


def with_pattern(df: DataFrame, price: str, window: int, name: str, top: bool = False, threshold: float = 0.02) -> DataFrame:
    """``df`` with ``name``: 1 for a broken-out pattern in the ``window`` bars before, 0.5 for one that forms, else 0.

    The lowest bar of each half (the first of equals) and the highest between
    them; the lows are alike within ``threshold``, the high stands out by as
    much.  ``top`` turns it round.  0 for the first bars and where a price is missing.
    """
    for column, value in two_halves(price, window, name, top, threshold).items():
        df = df.withColumn(column, value)
    return df.drop(*[f"_{name}_{x}" for x in ("seg", "l", "r", "m")])


def peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start, end) of the peaks of a series: level stretches, single values mostly, that are higher than what is beside them.

    A stretch is placed at its middle; one at an edge of the series is none.
    """
    turns = np.flatnonzero(x[1:] != x[:-1]) + 1
    start, end = np.concatenate([[0], turns]), np.concatenate([turns - 1, [len(x) - 1]])
    level = x[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (start[top] + end[top]) // 2, start[top], end[top]


def lowest(x: np.ndarray, at: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Per place and distance up to ``reach`` on one side, the lowest value from the place to there, no farther than a higher value or the edge of the series."""
    places = at[:, None] + step * np.arange(reach + 1)
    inside = (places >= 0) & (places < len(x))
    values = np.where(inside, x[np.clip(places, 0, len(x) - 1)], np.inf)
    beyond = np.logical_or.accumulate(values > x[at][:, None], axis=1)
    return np.minimum.accumulate(np.where(beyond, np.inf, values), axis=1)


def last_two(x: np.ndarray, window: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last two prominent peaks of each window of ``window`` + 1 values by the window's last place, -1 where there is none.

    A peak is prominent in a window if its height over the higher of the
    lowest values on both sides, each up to a higher value or the window's edge, is ``least`` or more.  A
    stretch that reaches an edge of the window is no peak there.  A peak is looked at once, with all windows
    that hold it, so that work grows with peaks times ``window``.
    """
    at, start, end = peaks(x)
    first, second = np.full(len(x), -1), np.full(len(x), -1)
    ahead = np.arange(window + 1)
    for low in range(0, len(at), PEAKS):
        p, a, b = (v[low : low + PEAKS] for v in (at, start, end))
        # Column k: the window that ends k places after the peak and starts window - k before it.
        right, left = lowest(x, p, window, 1), lowest(x, p, window, -1)[:, ::-1]
        last = p[:, None] + ahead
        whole = (last > b[:, None]) & (last - window < a[:, None]) & (last >= window) & (last < len(x))
        good = whole & (x[p][:, None] - np.maximum(left, right) >= least[np.clip(last, 0, len(x) - 1)])
        for k in ahead[::-1]:
            # A window meets its peaks in order, the farthest back first; it has one at most at a distance.
            held = p[good[:, k]]
            first[held + k], second[held + k] = second[held + k], held
    return first, second


def highest(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest value of each range of places, both ends included, from maxima of stretches of powers of two."""
    power = np.frexp(high - low + 1)[1] - 1
    out, stretch = np.full(len(low), -np.inf), x
    for k in range(int(power.max(initial=0)) + 1):
        here = power == k
        out[here] = np.maximum(stretch[low[here]], stretch[high[here] - (1 << k) + 1])
        if len(stretch) > 1 << k:
            stretch = np.maximum(stretch[: -(1 << k)], stretch[1 << k :])
    return out


def double_extremes(x: np.ndarray, window: int, prominent: float, tolerance: float, separation: int, top: bool = False) -> np.ndarray:
    """Per place of a series: does it end above the highest value between the last two prominent lows of its window, which are alike?  ``top`` turns it round.

    Shares are of the first low (or top); a place without a whole window has no pattern.
    """
    found = np.zeros(len(x), bool)
    sign = 1 if top else -1
    views = np.lib.stride_tricks.sliding_window_view(x, window + 1)
    mean = np.full(len(x), np.nan)
    for low in range(0, len(views), ROWS):
        mean[window + low : window + low + ROWS] = np.ascontiguousarray(views[low : low + ROWS]).mean(1)
    first, second = last_two(sign * x, window, prominent * np.abs(mean))
    at = np.flatnonzero((first >= 0) & (second - first >= separation))
    a, b = first[at], second[at]
    base, other, neck = x[a], x[b], -sign * highest(-sign * x, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = (base - neck) / base if top else (neck - base) / base
        broken = x[at] < neck if top else x[at] > neck
        found[at] = (depth > prominent) & (np.abs(base - other) / base < tolerance) & broken
    return found


#: Windows, and peaks, that are looked at together.
ROWS, PEAKS = 4096, 2048


def double_patterns(df: DataFrame, price: str = "close", window: int = 60, prominent: float = 0.02, tolerance: float = 0.03, separation: int = 5) -> DataFrame:
    """(key, date, double_bottom, double_top) of every bar with a price: 1 where it breaks the neckline of the pattern in the ``window`` bars before it.

    One Arrow pass per instrument, whose series is bounded by its dates.  The
    first ``window`` bars have none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        x = pdf[price].to_numpy(float)
        out = pdf[[KEY, TIME]].assign(double_bottom=np.int32(0), double_top=np.int32(0))
        if len(x) > window:
            for name, top in (("double_bottom", False), ("double_top", True)):
                out[name] = double_extremes(x, window, prominent, tolerance, separation, top).astype(np.int32)
        return out

    rows = df.select(KEY, TIME, F.col(price).cast("double").alias(price)).where(F.col(price).isNotNull() & ~F.isnan(price))
    kind = df.schema[TIME].dataType.simpleString()
    return rows.groupBy(KEY).applyInPandas(run, f"{KEY} string, {TIME} {kind}, double_bottom int, double_top int")
