"""Splits of windows, ranks of scores, out-of-fold models, against loops."""

from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import labels as L
from quantloom.operators import learning as M


def days_of(first, n, skip=()):
    return [d for d in (first + dt.timedelta(days=i) for i in range(n)) if d.weekday() < 5 and (d.year, d.month) not in skip]


def months_on(d, n):
    m = d.year * 12 + d.month - 1 + n
    return dt.date(m // 12, m % 12 + 1, 1)


def brute_rolling(days, train, val, test, step, holdout, purge):
    split = {d: "test" if d >= holdout else "train" for d in days}
    at, folds = days[0].replace(day=1), []
    while months_on(at, train + val + test) <= holdout:
        folds.append((months_on(at, train), months_on(at, train + val), months_on(at, train + val + test)))
        at = months_on(at, step)
    first = lambda x: sum(d < x for d in days)

    def mark(a, b, name):
        for d in days[a:b]:
            if split[d] == "train":
                split[d] = name

    for _, b, c in folds:
        mark(first(b), first(c), "test")
    for a, b, _ in folds:
        mark(first(a), first(b), "val")
        mark(max(0, first(a) - purge), first(a), "gap")
    mark(max(0, first(holdout) - purge), first(holdout), "gap")
    return split


@pytest.mark.parametrize(("train", "val", "test", "step", "holdout"), [(6, 2, 1, 3, dt.date(2022, 6, 15)), (3, 2, 2, 1, dt.date(2022, 1, 1)), (4, 1, 1, 5, dt.date(2030, 1, 1)), (60, 1, 1, 1, dt.date(2022, 6, 1))])
def test_rolling_months(train, val, test, step, holdout, spark):
    days = days_of(dt.date(2020, 3, 17), 1000, {(2021, 4)})
    df = spark.createDataFrame([(d,) for d in days for _ in range(2)], "trade_date date")
    got = {r.trade_date: r.split for r in L.rolling_months(df, train, val, test, step, holdout.isoformat(), 7).collect()}
    assert got == brute_rolling(days, train, val, test, step, holdout, 7)


@pytest.mark.parametrize("start", [dt.date(2022, 2, 10), dt.date(2030, 1, 1)])
def test_interleaved(start, spark):
    days = days_of(dt.date(2020, 5, 1), 900)
    split = {d: "test" if d >= start else "val" if d.month <= 3 else "train" for d in days}
    final = dict(split)
    for i, d in enumerate(days):
        if split[d] == "train":
            after = next((j for j in range(i + 1, len(days)) if split[days[j]] != "train"), len(days))
            before = next((j for j in range(i - 1, -1, -1) if split[days[j]] == "val"), -(10**6))
            if after - i <= 9 or i - before <= 9:
                final[d] = "gap"
    got = {r.trade_date: r.split for r in L.interleaved(spark.createDataFrame([(d,) for d in days], "trade_date date"), (1, 2, 3), start.isoformat(), 9).collect()}
    assert got == final


def test_auc_and_drift(spark):
    dice = random.Random(5)
    rows = [(g, dice.choice([None, float("nan"), *[float(x) for x in range(6)]]), dice.randint(0, 1)) for g in "ab" for _ in range(80)] + [("one", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r for r in M.auc(df.where("not isnan(s)"), "s", "y", ["g"]).collect()}
    for g in "ab":
        own = [(s, y) for h, s, y in rows if h == g and s is not None and s == s]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        assert got[g].auc == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
        steps = sorted({s for s, _ in own}, reverse=True)
        total, seen = 0.0, 0
        for t in steps:
            hits, n = sum(s >= t and y for s, y in own), sum(s >= t for s, _ in own)
            total += (hits - seen) * hits / n
            seen = hits
        assert got[g].average_precision == pytest.approx(total / len(pos))
    assert got["one"].auc is None and got["one"].average_precision is None
    drift = M.feature_drift(df, ["s"], F.col("y") == 1).first()
    own = [(0.0 if s is None or s != s else s, y) for _, s, y in rows]
    pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
    raw = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert drift.auc == pytest.approx(max(raw, 1 - raw)) and (drift.n_train, drift.n_test) == (len(neg), len(pos))


def test_out_of_fold_sees_train_days_only(spark):
    rng = np.random.default_rng(2)
    first = dt.date(2021, 1, 1)
    rows = []
    for i in range(60):
        for c in "abcd":
            x = float(rng.normal())
            # Days that are neither train nor test carry another law.
            rows.append((c, first + dt.timedelta(days=i), x, None if i % 13 == 0 else (2.0 if i < 30 or i >= 35 else -50.0) * x))
    panel = spark.createDataFrame(rows, "ts_code string, trade_date date, x double, y double")
    folds = spark.createDataFrame([(0, "train" if i < 30 else "gap" if i < 35 else "test", first + dt.timedelta(days=i)) for i in range(60)] + [(1, "test", first)], "fold int, split string, trade_date date")
    scored = M.out_of_fold(panel, folds, ["x"], "y")
    got = scored.collect()
    assert {r.fold for r in got} == {0} and len(got) == 100
    assert all(r.pred == pytest.approx(2 * r.x, abs=0.3 + 0.15 * abs(r.x)) for r in got)
    m = M.fold_metrics(scored, "y").first()
    assert m.n == sum(r.y is not None for r in got) and m.ic == pytest.approx(1) and m.hit_rate > 0.95
    assert {r.metric: r.folds for r in M.over_folds(M.fold_metrics(scored, "y")).collect()} == dict.fromkeys(["rmse", "mae", "r2", "hit_rate", "ic"], 1)
    assert M.out_of_fold(panel, folds.where("split = 'test'"), ["x"], "y").count() == 0


def test_classifier_with_rare_labels(spark):
    dice = random.Random(1)
    rows = [(i, x, None if i % 9 == 0 else dice.random(), int(x > 0.92)) for i in range(800) for x in [dice.random()]]
    df = spark.createDataFrame(rows, "id int, x double, noise double, y int")
    scored, importance = M.classify(df.where("id < 600"), df.where("id >= 600"), ["x", "noise"], "y", trees=5)
    got = scored.collect()
    assert sum((r.p >= 0.5) == bool(r.y) for r in got) > 0.95 * len(got) and importance["x"] > importance["noise"]
    with pytest.raises(ValueError, match="both labels"):
        M.classify(df.where("y = 0"), df, ["x"], "y")
    weights = {r.y: r.t for r in M.class_weights(df, "y").groupBy("y").agg(F.sum("_w").alias("t")).collect()}
    assert weights[0] == pytest.approx(weights[1])


def test_auc_of_one_group_is_no_single_task(spark):
    """Without groups the scores still lie in ranges: no window over all rows."""
    rows = spark.range(1000).selectExpr("cast(id % 500 as double) as s", "cast(id % 3 = 0 as int) as y")
    found = M.auc(rows, "s", "y", [])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"sum\(_[np]#\d+L?\) windowspecdefinition\((\w+)#", plan)) == {"_range"}
    assert found.first()["n"] == 1000


def test_limit_classifier_reads_bars_once(spark, sf):
    from quantloom.plans import registry

    scored = registry.QUERIES["l19_limit_classifier"](spark, "/root/testdata/sf0.01")
    plan = spark._jvm.PythonSQLUtils.explainString(scored._jdf.queryExecution(), "extended")
    assert "lineitem.parquet" not in plan and "l_shipdate" not in plan


def test_drift_classifier_derives_its_rows_once(spark):
    passed = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            passed.add(len(p))
            yield p

    rows = spark.range(400).select("id", (F.col("id") % 7 + F.col("id") / 100).alias("x")).mapInPandas(count, "id long, x double")
    M.drift_classifier(rows, ["x"], F.col("id") >= 200, ["id"])[0].collect()
    assert passed.value == 400
