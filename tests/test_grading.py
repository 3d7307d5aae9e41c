"""Repetition, golden cases and suspicious changes on edge cases."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quantloom.operators import grading as G


def test_repetition(spark):
    dice = random.Random(3)
    texts = ["".join(dice.choices("ab \n", k=dice.randint(0, 120))) for _ in range(60)] + [None, "", "x" * 10, "x" * 11, "short"]

    def brute(t):
        t = re.sub(r"\s+", "", t or "")
        return sum(c >= 3 for c in Counter(t[i : i + 8] for i in range(len(t) - 7)).values())

    got = {r.id: r.repeats for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", G.repetition(F.col("t")).alias("repeats")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_golden_cases(spark):
    cases = spark.createDataFrame([
        (1, ["a", "b"], None, 5, 2.5, None, None), (2, ["a"], ["x", "y"], 5, None, None, 2), (3, None, ["x"], None, None, None, None), (4, None, None, 0, 7.0, 0.5, None), (5, [], [], 0, None, None, 0),
    ], "case_id int, all_of array<string>, any_of array<string>, least_chars int, figure double, tolerance double, least_news int")
    answers = spark.createDataFrame([(1, "it is 2.55 or -3", ["b", "a", "c"]), (2, "[2024-01-02] one", ["z"]), (4, "6.4", []), (5, None, None)], "case_id int, answer string, ids array<string>")
    got = {r.case_id: (r.passed, r.reasons) for r in G.graded(cases, answers).collect()}
    assert got[1] == (True, []) and got[2] == (False, ["missing ids", "none of the ids", "too few news"]) and got[3] == (False, ["none of the ids", "too short"]) and got[4] == (False, ["no such figure"])
    assert got[5] == (False, ["none of the ids"])


def test_suspicious(spark):
    d = dt.date(2020, 1, 1)
    rows = [("a", d, "backdoor listing", dt.date(2020, 2, 1), "n2"), ("a", d, "backdoor listing", d, "n1"), ("a", d, None, d, "n"), ("b", d, "plain", d, "n")]
    got = G.suspicious(spark.createDataFrame(rows, "ts_code string, start_date date, reason string, ann_date date, name string"), ["backdoor", "merger"]).collect()
    assert [tuple(r) for r in got] == [("a", d, "backdoor listing", d, "n1")]
