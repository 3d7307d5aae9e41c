"""Distribution of forecast errors: a Student t by moments, and probabilities of what a forecast may come to."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ensembles import pair

#: Degrees of freedom aren't taken below this; without heavy tails there is no limit, which is the normal distribution.
LEAST_DF, LEAST_SIGMA = 2.5, 1e-6
THRESHOLDS = (-5.0, -3.0, -1.0, 0.0, 1.0, 3.0, 5.0)


def fit(df: DataFrame, prediction: str, target: str, by: list[str], least: int = 1000) -> DataFrame:
    """(by, n, mu, sigma, df) of target minus prediction per group, by moments of its finite pairs.

    With excess kurtosis k > 0 a t of 4 + 6 / k degrees has it; its variance,
    df / (df - 2), is taken out of sigma.  df is null for the normal
    distribution.  Groups of fewer than ``least`` pairs have no row.
    """
    error = F.col(target).cast("double") - F.col(prediction).cast("double")
    rows = df.where(pair(F.col(prediction), F.col(target))).select(*by, error.alias("_e"))
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_e").alias("mu"), F.stddev_pop("_e").alias("_s"), F.kurtosis("_e").alias("_k")).where(F.col("n") >= least)
    heavy = F.col("_k").isNotNull() & ~F.isnan("_k") & (F.col("_k") > 0)
    degrees = F.when(heavy, F.greatest(4 + 6 / F.col("_k"), F.lit(LEAST_DF)))
    scale = F.when(degrees.isNull(), F.col("_s")).otherwise(F.col("_s") * F.sqrt((degrees - 2) / degrees))
    return found.select(*by, "n", "mu", F.greatest(scale, F.lit(LEAST_SIGMA)).alias("sigma"), degrees.alias("df"))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    return (gamma(a) + gamma(b) - gamma(a + b)).astype(float)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    turn = x > (a + 1) / (a + b + 2)
    u, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(u) + q * np.log1p(-u) - _log_beta(p, q)) / p
    front = np.where(u <= 0, 0.0, front)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(u), 1 / keep(1 - (p + q) * u / (p + 1))
    value = d.copy()
    for m in range(1, 300):
        for term in (m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / keep(1 + term * d)
            c = keep(1 + term / c)
            value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return np.where(turn, 1 - front * value, front * value)


def t_cdf(z: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T <= z) for df degrees of freedom; infinite ones are the normal distribution."""
    z, df = np.broadcast_arrays(np.asarray(z, float), np.asarray(df, float))
    out = 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2)) if z.size else np.zeros(z.shape)
    t = np.isfinite(df)
    if t.any():
        tail = 0.5 * incomplete_beta(df[t] / (df[t] + z[t] ** 2), df[t] / 2, np.full(t.sum(), 0.5))
        out[t] = np.where(z[t] > 0, 1 - tail, tail)
    return out


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The z with P(T <= z) = p, by halving."""
    df = np.asarray(df, float)
    low, high = np.full(df.shape, -1e3), np.full(df.shape, 1e3)
    for _ in range(90):
        middle = (low + high) / 2
        below = t_cdf(middle, df) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def label(threshold: float) -> str:
    """prob_gt_1pct, prob_lt_2_5pct, ..."""
    size = f"{abs(threshold):g}".replace(".", "_")
    return f"prob_{'gt' if threshold >= 0 else 'lt'}_{size}pct"


def _probability(above: bool):
    @F.pandas_udf("double")
    def p(prediction: pd.Series, mu: pd.Series, sigma: pd.Series, df: pd.Series, threshold: pd.Series) -> pd.Series:
        z = (threshold - prediction - mu) / sigma
        share = t_cdf((-z if above else z).to_numpy(float), df.fillna(np.inf).to_numpy(float))
        return pd.Series(share).where(prediction.notna().to_numpy() & sigma.notna().to_numpy())

    return p


def _quantile(p: float):
    @F.pandas_udf("double")
    def q(df: pd.Series) -> pd.Series:
        values = df.fillna(np.inf)
        kinds = np.unique(values)
        return values.map(dict(zip(kinds, t_quantile(p, kinds), strict=True)))

    return q


def probabilities(df: DataFrame, model: DataFrame, prediction: str, by: list[str], thresholds: tuple[float, ...] = THRESHOLDS, coverage: float = 0.8) -> DataFrame:
    """``df`` with the chance of ending above each threshold from 0 on and below each negative one, prob_up, prob_down, and an interval of ``coverage``.

    ``model`` is what ``fit`` gave for the same ``by``; rows of groups without one have nulls.
    """
    held = model.select(*by, F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"), F.col("df").alias("_df"))
    met = df.join(held, by, "left") if by else df.join(held, F.lit(True), "left")
    above, below = _probability(True), _probability(False)

    def chance(threshold: float, over: bool) -> Column:
        return (above if over else below)(F.col(prediction).cast("double"), F.col("_mu"), F.col("_sigma"), F.col("_df"), F.lit(threshold))

    out = {label(t): chance(t, t >= 0) for t in thresholds} | {"prob_up": chance(0.0, True), "prob_down": chance(0.0, False)}
    tail, name = (1 - coverage) / 2, f"{round(coverage * 100)}"
    centre = F.col(prediction) + F.col("_mu")
    out |= {f"pi_lo_{name}": centre + F.col("_sigma") * _quantile(tail)(F.col("_df")), f"pi_hi_{name}": centre + F.col("_sigma") * _quantile(1 - tail)(F.col("_df"))}
    return met.withColumns(out).drop("_mu", "_sigma", "_df")
