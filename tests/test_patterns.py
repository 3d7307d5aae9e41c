"""Chart patterns and residual distributions against loops and numeric integrals."""

from __future__ import annotations

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import patterns as P
from quantloom.operators import residuals as D


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def walk(seed, n, step=0.02):
    dice = random.Random(seed)
    x, out = 50.0, []
    for i in range(n):
        x *= math.exp(dice.choice([-1, 0, 1]) * step + 0.05 * math.sin(i / 5) * step)
        out.append(round(x, 2))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    prices = {"a": walk(1, 300), "b": walk(2, 150, 0.01), "flat": [5.0] * 90, "short": walk(3, 7)}
    rows = [(c, day(i), x) for c, xs in prices.items() for i, x in enumerate(xs)]
    return prices, spark.createDataFrame(rows, "ts_code string, trade_date date, close double").repartition(3).cache()


def halves(x, window, top, threshold=0.02):
    out = [0.0] * len(x)
    sign = -1 if top else 1
    for i in range(window, len(x)):
        s, mid = x[i - window : i], window // 2
        a = min(range(mid), key=lambda j: (sign * s[j], j))
        b = min(range(mid, window), key=lambda j: (sign * s[j], j))
        m = max(range(a, b + 1), key=lambda j: (sign * s[j], -j))
        if a < m < b and abs(s[a] - s[b]) / (s[a] + 1e-10) < threshold and all(sign * s[m] > sign * s[k] * (1 + sign * threshold) for k in (a, b)):
            out[i] = 1.0 if sign * s[-1] > sign * s[m] else 0.5 if sign * s[-1] > sign * (s[a] + s[m]) / 2 else 0.0
    return out


@pytest.mark.parametrize(("window", "top"), [(10, False), (20, False), (10, True), (20, True)])
def test_two_halves(window, top, bars):
    prices, df = bars
    got = {}
    for r in sorted(P.with_pattern(df, "close", window, "w", top).collect()):
        got.setdefault(r.ts_code, []).append(r.w)
    assert got == {c: halves(x, window, top) for c, x in prices.items()}
    assert any(v == 1.0 for v in got["a"]) and any(v == 0.5 for v in got["a"])


def find_peaks(x, least):
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                at = (i + j) // 2
                sides = []
                for step in (-1, 1):
                    k, low = at, x[at]
                    while 0 <= k < n and x[k] <= x[at]:
                        low, k = min(low, x[k]), k + step
                    sides.append(low)
                if x[at] - max(sides) >= least:
                    out.append(at)
            i = j
        i += 1
    return out


def doubles(x, window, top):
    out = [0] * len(x)
    for i in range(window, len(x)):
        s = np.array(x[i - window : i + 1])
        found = find_peaks(list(s if top else -s), 0.02 * s.mean())
        if len(found) >= 2 and found[-1] - found[-2] >= 5:
            a, b = found[-2:]
            neck = s[a : b + 1].min() if top else s[a : b + 1].max()
            depth = (s[a] - neck) / s[a] if top else (neck - s[a]) / s[a]
            broken = s[-1] < neck if top else s[-1] > neck
            out[i] = int(depth > 0.02 and abs(s[a] - s[b]) / s[a] < 0.03 and broken)
    return out


@pytest.mark.parametrize("rows", [4096, 7])
def test_double_patterns(rows, bars, monkeypatch):
    monkeypatch.setattr(P, "ROWS", rows)
    prices, df = bars
    got = {}
    for r in sorted(P.double_patterns(df, window=40).collect()):
        got.setdefault(r.ts_code, []).append((r.double_bottom, r.double_top))
    assert got == {c: list(zip(doubles(x, 40, False), doubles(x, 40, True), strict=True)) for c, x in prices.items()}
    assert any(a for a, _ in got["a"]) and any(b for _, b in got["a"])
    assert P.double_patterns(df.limit(0)).count() == 0


@pytest.mark.parametrize("df", [2.5, 4.3, 7.0, 60.0, 1e4])
def test_t_distribution(df):
    for z in (-7.0, -1.3, 0.0, 0.4, 2.2, 30.0):
        # The density in terms of the angle of z, which is bounded.
        angle = np.linspace(-math.pi / 2, math.atan(z / math.sqrt(df)), 400_001)
        expected = np.trapezoid(np.cos(angle) ** (df - 1), angle) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        assert D.t_cdf(np.array([z]), np.array([df]))[0] == pytest.approx(expected, abs=2e-7)
    for p in (0.1, 0.5, 0.95):
        assert D.t_cdf(D.t_quantile(p, np.array([df])), np.array([df]))[0] == pytest.approx(p, abs=1e-9)


def test_normal_limit():
    assert D.t_cdf(np.array([1.959964]), np.array([np.inf]))[0] == pytest.approx(0.975, abs=1e-6)


def test_fit_and_probabilities(spark):
    rng = np.random.default_rng(5)
    heavy, thin = 2 * rng.standard_t(6, 4000) + 0.3, rng.uniform(-1, 1, 2000)
    rows = [("h", 1.0, 1.0 + float(e)) for e in heavy] + [("u", 0.0, float(e)) for e in thin] + [("few", 0.0, 1.0)] * 5 + [("u", None, 1.0), ("u", 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, pred double, y double")
    model = {r.g: r for r in D.fit(df, "pred", "y", ["g"]).collect()}
    assert set(model) == {"h", "u"} and model["u"].df is None and model["u"].n == 2000
    k = ((heavy - heavy.mean()) ** 4).mean() / heavy.var() ** 2 - 3
    assert model["h"].df == pytest.approx(4 + 6 / k) and model["h"].mu == pytest.approx(heavy.mean())
    assert model["h"].sigma == pytest.approx(heavy.std() * math.sqrt((model["h"].df - 2) / model["h"].df))
    asked = spark.createDataFrame([("h", 1.0), ("u", 0.5), ("few", 0.0), ("h", None)], "g string, pred double")
    got = {(r.g, r.pred): r for r in D.probabilities(asked, D.fit(df, "pred", "y", ["g"]), "pred", ["g"]).collect()}
    h = got["h", 1.0]
    assert h.prob_gt_3pct == pytest.approx((1 + heavy > 3).mean(), abs=0.03) and h.prob_lt_1pct == pytest.approx((1 + heavy < -1).mean(), abs=0.03)
    assert h.prob_up + h.prob_down == pytest.approx(1) and ((1 + heavy > h.pi_lo_80) & (1 + heavy < h.pi_hi_80)).mean() == pytest.approx(0.8, abs=0.03)
    assert got["few", 0.0].prob_up is None and got["h", None].prob_up is None
    whole = D.probabilities(asked, D.fit(df, "pred", "y", []), "pred", [])
    assert whole.where(F.col("pred").isNotNull() & F.col("prob_up").isNull()).count() == 0


@pytest.mark.parametrize("top", [False, True])
def test_double_extremes_of_a_series(top, monkeypatch):
    dice = random.Random(4)
    monkeypatch.setattr(P, "PEAKS", 3)
    for levels in (3, 6, 60):
        x = [float(50 + dice.randrange(levels)) for _ in range(300) for _ in range(dice.choice([1, 1, 2, 25]))]
        assert P.double_extremes(np.array(x), 40, 0.02, 0.03, 5, top).astype(int).tolist() == doubles(x, 40, top)


def test_work_of_double_extremes_grows_with_peaks():
    x = np.array(walk(5, 30_000))
    began = time.process_time()
    assert P.double_extremes(x, 60, 0.02, 0.03, 5).any()
    # 106 microseconds a bar, so 3 seconds for both sides, where every window was searched by itself.
    assert time.process_time() - began < 0.8
