"""Trailing accuracy, blends, stacks and regimes against loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import ensembles as E
from quantloom.operators import regimes as R
from quantloom.plans import registry


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def panel(spark):
    dice = random.Random(3)
    hole = lambda x: None if dice.random() < 0.15 else x
    rows = [(c, day(n), hole(dice.gauss(0, 1)), hole(dice.gauss(0, 1)), hole(dice.gauss(0, 1))) for c in "ab" for n in range(90)]
    rows += [("flat", day(n), 1.0, dice.gauss(0, 1), 0.5) for n in range(30)] + [("nan", day(n), float("nan"), float("inf"), 0.5) for n in range(30)]
    return rows, spark.createDataFrame(rows, "ts_code string, trade_date date, p double, q double, y double").repartition(3).cache()


def series(rows, code):
    own = sorted(r for r in rows if r[0] == code)
    return [r[1] for r in own], [np.array([np.nan if v is None or not np.isfinite(v) else v for v in (r[k] for r in own)]) for k in (2, 3, 4)]


def brute_ic(p, y, h, lookback, least):
    out = np.full(len(p), np.nan)
    for t in range(len(p)):
        ok = [s for s in range(max(0, t - h)) if not np.isnan(p[s]) and not np.isnan(y[s])]
        if len(ok) >= least:
            a, b = p[ok[-lookback:]], y[ok[-lookback:]]
            if a.std() and b.std():
                out[t] = np.corrcoef(a, b)[0, 1]
    return out


def test_trailing_ic(panel):
    rows, df = panel
    got = {(r.ts_code, r.trade_date): (r.ip, r.iq) for r in E.trailing_ic(df, {"ip": ("p", "y", 1), "iq": ("q", "y", 4)}, 20, 8).collect()}
    for code in ("a", "b", "flat", "nan"):
        days, (p, q, y) = series(rows, code)
        for k, expected in enumerate((brute_ic(p, y, 1, 20, 8), brute_ic(q, y, 4, 20, 8))):
            for d, e in zip(days, expected, strict=True):
                g = got[code, d][k]
                assert (g is None) == np.isnan(e) and (g is None or g == pytest.approx(e, abs=1e-9)), (code, d, k)


def brute_blend(method, preds, ics, k, floor):
    able = [i for i in range(len(preds)) if preds[i] is not None and ics[i] is not None]
    none = all(i is None for i in ics)
    if method == "mean":
        w = [1] * len(preds)
    elif method == "ic_weighted":
        w = [1 if none else abs(i or 0) for i in ics]
    elif method == "ic_filter":
        w = [1 if none or (i is not None and abs(i) >= floor) else 0 for i in ics]
    else:
        best = sorted(able, key=lambda i: (-abs(ics[i]), i))[:k]
        w = [1 if not able or i in best else 0 for i in range(len(preds))]
    w = [0 if p is None else x for p, x in zip(preds, w, strict=True)]
    return sum(x * (p or 0) for p, x in zip(preds, w, strict=True)) / sum(w) if sum(w) else None


@pytest.mark.parametrize("method", ["mean", "ic_weighted", "ic_filter", "top_k"])
def test_blends(method, spark):
    dice = random.Random(8)
    pick = lambda: dice.choice([None, 0.0, -0.3, 0.3, 0.1, 0.7])
    rows = [(i, *(pick() for _ in range(6))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, p0 double, p1 double, p2 double, i0 double, i1 double, i2 double")
    got = {r.id: r.b for r in df.select("id", E.blend(["p0", "p1", "p2"], ["i0", "i1", "i2"], method, 2, 0.3).alias("b")).collect()}
    for i, *v in rows:
        expected = brute_blend(method, v[:3], v[3:], 2, 0.3)
        assert got[i] == (None if expected is None else pytest.approx(expected, abs=1e-12)), v


def test_ridge_stack(panel):
    rows, df = panel
    got = {(r.ts_code, r.trade_date): r.stack for r in E.ridge_stack(df, ["p", "q"], "y", 2, 25, 10, 5.0).collect()}
    for code in ("a", "b", "flat", "nan"):
        days, (p, q, y) = series(rows, code)
        x, fit, at = np.column_stack([p, q]), None, None
        for t, d in enumerate(days):
            ok = [s for s in range(max(0, t - 2)) if not np.isnan([*x[s], y[s]]).any()]
            if len(ok) >= 25 and (at is None or t - at >= 10):
                xm, ym = x[ok].mean(0), y[ok].mean()
                coef = np.linalg.solve((x[ok] - xm).T @ (x[ok] - xm) + 5 * np.eye(2), (x[ok] - xm).T @ (y[ok] - ym))
                fit, at = (coef, ym - coef @ xm), t
            g = got[code, d]
            expected = None if fit is None or np.isnan(x[t]).any() else fit[0] @ x[t] + fit[1]
            assert (expected is None and (g is None or np.isnan(g))) or g == pytest.approx(expected, abs=1e-9), (code, d)


def brute_merge(blocks, least):
    blocks = [list(b) for b in blocks]
    while True:
        short = [i for i, b in enumerate(blocks) if b[3] < least]
        if not short or len(blocks) == 1:
            return [tuple(b) for b in blocks]
        i = min(short, key=lambda k: blocks[k][3])
        sides = [k for k in (i - 1, i + 1) if 0 <= k < len(blocks)]
        o = min(sides, key=lambda k: blocks[k][3])
        a, b = min(i, o), max(i, o)
        blocks[a : b + 1] = [[blocks[o][0], blocks[a][1], blocks[b][2], blocks[a][3] + blocks[b][3]]]
        out = []
        for x in blocks:
            if out and out[-1][0] == x[0]:
                out[-1][2], out[-1][3] = x[2], out[-1][3] + x[3]
            else:
                out.append(x)
        blocks = out


def test_merged_blocks_random():
    dice = random.Random(6)
    for _ in range(400):
        sizes = [dice.randint(1, 9) for _ in range(dice.randint(1, 14))]
        blocks, at = [], 0
        for k, n in enumerate(sizes):
            blocks.append(("bull" if k % 2 else "bear", at, at + n - 1, n))
            at += n
        assert R.merged(blocks, 5) == brute_merge(blocks, 5), blocks


def brute_split(flags, least, val_days, test_days, purge):
    raw = []
    for i, f in enumerate(flags):
        name = "bull" if f else "bear"
        if raw and raw[-1][0] == name:
            raw[-1][2], raw[-1][3] = i, raw[-1][3] + 1
        else:
            raw.append([name, i, i, 1])
    blocks = brute_merge(raw, least)
    bears = [k for k, b in enumerate(blocks) if b[0] == "bear"]
    val = max(bears, key=lambda k: blocks[k][3]) if bears else max(0, len(blocks) - 2)
    out = []
    for k, b in enumerate(blocks):
        split, tail = ("val", val_days) if k == val else ("test", test_days) if k == len(blocks) - 1 else ("train", b[3])
        tail = min(tail, b[3])
        out += ["train"] * (b[3] - tail) + [split] * tail
    final = list(out)
    for i in range(1, len(out)):
        if out[i] != out[i - 1]:
            final[max(0, i - purge) : i] = ["gap"] * (i - max(0, i - purge))
    return final


def test_regime_splits(spark):
    dice = random.Random(9)
    walks = {c: [dice.random() < (0.85 if (i // 17 + k) % 2 else 0.15) for i in range(n)] for k, (c, n) in enumerate((("a", 160), ("b", 90), ("one", 1), ("up", 40)))}
    walks["up"] = [True] * 40
    days = spark.createDataFrame([(c, day(i), f) for c, fs in walks.items() for i, f in enumerate(fs)], "ts_code string, trade_date date, f boolean").repartition(4)
    blocks = R.assign(R.merge_short(R.raw_blocks(days, F.col("f"), "ts_code"), "ts_code", 12), "ts_code", 20, 18)
    got = {}
    for r in sorted(R.split_days(days, blocks, "ts_code", 5).collect()):
        got.setdefault(r.ts_code, []).append(r.split)
    assert got == {c: brute_split(fs, 12, 20, 18, 5) for c, fs in walks.items()}


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")


def test_regime_splits_read_bars_once(spark, sf):
    plan = plan_of(registry.QUERIES["l12_regime_split"](spark, sf))
    assert "lineitem.parquet" not in plan and "l_shipdate" not in plan
    # A frame from each day to the last one is added up anew for every day.
    assert "currentrow$(), unboundedfollowing" not in plan.lower()


def test_regime_splits_of_repeated_days(spark):
    days = spark.createDataFrame([("a", day(i // 2), (i // 20) % 2 == 0) for i in range(100)], "ts_code string, trade_date date, f boolean").repartition(4)
    once = days.distinct()
    blocks = R.assign(R.merge_short(R.raw_blocks(once, F.col("f"), "ts_code"), "ts_code", 5), "ts_code", 6, 6)
    assert sorted(R.split_days(days, blocks, "ts_code", 3).collect()) == sorted(R.split_days(once, blocks, "ts_code", 3).collect())
