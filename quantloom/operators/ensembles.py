"""Models over time: what their trailing accuracy was when a bar was forecast, adaptive blends, a walk-forward ridge stack."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation
from .ordering import spread
from .timeseries import KEY, TIME, series


def known(h: int):
    """The rows of a series whose target, h rows ahead, is known before the current row."""
    return series().rowsBetween(Window.unboundedPreceding, -(h + 1))


def pair(x: Column, y: Column) -> Column:
    """Whether both sides are there and finite."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    return F.coalesce(ok(x) & ok(y), F.lit(False))


def trailing_ic(df: DataFrame, models: dict[str, tuple[str, str, int]], lookback: int = 120, least: int = 40) -> DataFrame:
    """``df`` with a column per model {name: (prediction, target, h)}: the correlation that was known at each bar.

    It spans the last ``lookback`` complete pairs whose target, h rows ahead,
    lies before the bar; rows without a complete pair take no place in it.  Null
    with fewer than ``least`` pairs, or where a side doesn't vary.  All windows share one exchange by series.
    """
    out = spread(df, KEY)
    for name, (x, y, h) in models.items():
        whole = pair(F.col(x), F.col(y))
        w = Window.partitionBy(KEY, "_whole").orderBy(TIME).rowsBetween(-(lookback - 1), 0)
        varies = lambda c: F.min(c).over(w) < F.max(c).over(w)  # noqa: B023, E731
        ic = F.when((F.count(F.lit(1)).over(w) >= least) & varies(x) & varies(y), _corr_over(x, y, w))
        marked = out.withColumn("_whole", whole).withColumn("_ic", F.when(F.col("_whole"), F.struct(ic.alias("ic"))))
        out = marked.withColumn(name, F.last("_ic", ignorenulls=True).over(known(h))["ic"]).drop("_whole", "_ic")
    return out


def _corr_over(x: str, y: str, w) -> Column:
    """Correlation over a window from centred moments; a window has no nulls here."""
    return F.covar_pop(x, y).over(w) / (F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def sign_corrected(prediction: Column, ic: Column, least: float = 0.04) -> Column:
    """The prediction, turned round where its trailing correlation is negative and at least ``least`` in size."""
    return F.when((ic < 0) & (F.abs(ic) >= least), -prediction).otherwise(prediction)


def blend(predictions: list[str], ics: list[str], method: str, top_k: int = 1, floor: float = 0.0) -> Column:
    """One prediction per bar from several models.

    ``mean``: all alike.  ``ic_weighted``: by size of the trailing correlation.
    ``ic_filter``: those of at least ``floor`` in size, alike.  ``top_k``: the k
    largest in size among the models that predict, ties in the order given.  Where no model has a correlation yet, all
    count alike.  Missing predictions don't count; without any weight the blend is null.
    """
    return _weighed(_weights(predictions, ics, method, top_k, floor), predictions)


def with_blends(df: DataFrame, predictions: list[str], ics: list[str], wanted: dict[str, tuple[str, int, float]]) -> DataFrame:
    """``df`` with a column per blend {name: (method, top_k, floor)}, as ``blend`` gives them.

    Weights are columns before they are used, twice each: so the compiled methods stay small enough for the JVM to optimise.
    """
    held = {n: [f"_{n}_{k}" for k in range(len(predictions))] for n in wanted}
    weighed = df.withColumns({c: w for n, how in wanted.items() for c, w in zip(held[n], _weights(predictions, ics, *how), strict=True)})
    done = weighed.withColumns({n: _weighed([F.col(c) for c in cs], predictions) for n, cs in held.items()})
    return done.drop(*[c for cs in held.values() for c in cs])


def _weighed(weights: list[Column], predictions: list[str]) -> Column:
    total = reduce(lambda a, b: a + b, weights)
    value = reduce(lambda a, b: a + b, [w * F.coalesce(F.col(x), F.lit(0.0)) for w, x in zip(weights, predictions, strict=True)])
    return F.when(total > 0, value / total)


def _weights(predictions: list[str], ics: list[str], method: str, top_k: int, floor: float) -> list[Column]:
    """The weight of each prediction in a blend, 0 where it is missing."""
    p = [F.col(c) for c in predictions]
    size = [F.abs(F.col(c)) for c in ics]
    none = reduce(lambda a, b: a & b, [c.isNull() for c in size])
    if method == "mean":
        weights = [F.lit(1.0)] * len(p)
    elif method == "ic_weighted":
        weights = [F.when(none, 1.0).otherwise(F.coalesce(s, F.lit(0.0))) for s in size]
    elif method == "ic_filter":
        weights = [F.when(none | (s >= floor), 1.0).otherwise(0.0) for s in size]
    elif method == "top_k":
        able = [s.isNotNull() & x.isNotNull() for s, x in zip(size, p, strict=True)]
        nobody = ~reduce(lambda a, b: a | b, able)
        better = lambda j, i: (size[j] >= size[i]) if j < i else (size[j] > size[i])
        place = [reduce(lambda a, b: a + b, [F.coalesce((able[j] & better(j, i)).cast("int"), F.lit(0)) for j in range(len(p)) if j != i], F.lit(0)) for i in range(len(p))]
        weights = [F.when(nobody | (a & (n < top_k)), 1.0).otherwise(0.0) for a, n in zip(able, place, strict=True)]
    else:
        raise ValueError(f"no such blend: {method}")
    return [F.when(x.isNull(), 0.0).otherwise(w) for w, x in zip(weights, p, strict=True)]


def ridge_stack(df: DataFrame, predictions: list[str], target: str, h: int = 1, least: int = 80, every: int = 15, alpha: float = 5.0) -> DataFrame:
    """``df`` with ``stack``, a ridge regression on the predictions that is fitted anew every ``every`` rows, and ``coefs`` (intercept last) in use.

    A fit takes all complete pairs whose target, h rows ahead, lies before its
    row, the first as soon as there are ``least``.  Its normal equations are
    running sums of products, read at the rows where a fit is due; only those
    rows are solved.  The intercept carries no penalty.  Null before the first fit and where a
    prediction is missing.
    """
    m = len(predictions)
    whole = reduce(lambda a, b: a & b, [pair(F.col(c), F.col(target)) for c in predictions])
    x = [F.col(c).cast("double") for c in predictions]
    columns = [*x, F.col(target).cast("double"), F.lit(1.0)]
    # Upper triangle of the outer product of (predictions, target, 1); the count comes last.
    products = [columns[i] * columns[j] for i in range(m + 2) for j in range(i, m + 2)]
    sums = [F.coalesce(F.sum(F.when(F.col("_whole"), v)).over(known(h)), F.lit(0.0)) for v in products]
    w = series()
    rows = df.withColumn("_whole", whole).withColumn("_sums", F.array(*sums)).withColumn("_n", F.element_at("_sums", -1)).withColumn("_row", F.row_number().over(w))
    first = F.min(F.when(F.col("_n") >= least, F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    due = rows.withColumn("_due", F.coalesce((F.col("_row") - first) % every == 0, F.lit(False)))
    upper = [(i, j) for i in range(m + 2) for j in range(i, m + 2)]

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            at = [k for k, v in enumerate(batch) if v is not None]
            if at:
                s = np.zeros((len(at), m + 2, m + 2))
                flat = np.stack([np.asarray(batch.iloc[k], float) for k in at])
                for k, (i, j) in enumerate(upper):
                    s[:, i, j] = s[:, j, i] = flat[:, k]
                n = s[:, -1, -1][:, None, None]
                mean = s[:, : m + 1, -1] / n[:, :, 0]
                centred = s[:, : m + 1, : m + 1] - n * mean[:, :, None] * mean[:, None, :]
                coefs = np.linalg.solve(centred[:, :m, :m] + alpha * np.eye(m), centred[:, :m, m, None])[:, :, 0]
                intercept = mean[:, m] - (coefs * mean[:, :m]).sum(1)
                for k, row in zip(at, np.column_stack([coefs, intercept]).tolist(), strict=True):
                    out[k] = row
            yield pd.Series(out)

    fitted = due.withColumn("_fit", solve(F.when(F.col("_due"), F.col("_sums"))))
    used = fitted.withColumn("coefs", F.last("_fit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    value = reduce(lambda a, b: a + b, [F.col("coefs")[i] * x[i] for i in range(m)]) + F.col("coefs")[m]
    return used.withColumn("stack", value).drop("_whole", "_sums", "_n", "_row", "_due", "_fit")


def information(df: DataFrame, prediction: str, target: str, by: list[str]) -> DataFrame:
    """Per group: correlation of prediction and target, and pairs."""
    rows = df.where(pair(F.col(prediction), F.col(target)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(prediction, target).alias("ic"))
