"""Hard negatives against loops over all rows, and against SQL."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import hard_negatives as hn

SHAPE = "vec_id long, embedding array<float>, label int, anchor_id string, score string, slot int, row_tile int"


def brute(rows, each=7, k=5, n=5):
    """rows: (vec_id, embedding, label); anchors are ids divisible by ``each``."""
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if i not in one or (label, v) < one[i]:
            one[i] = (label, v)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    low, high = -(1 << 63), (1 << 63) - 1
    out = []
    for a in (i for i in whole if i % each == 0):
        mine, va = whole[a]
        scored = sorted((-min(max(sum(x * y for x, y in zip(va, v, strict=False)), low), high), i, label) for i, (label, v) in whole.items() if i != a)
        positives = [(-s, i) for s, i, label in scored if label == mine][:k]
        for s, p in positives:
            negatives = [(-t, i) for t, i, label in scored if label != mine and 80 * s <= -100 * t <= 100 * s][:n]
            out += [(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(negatives)]
    return sorted(out)


def cases():
    dice = random.Random(5)
    rows = [(i, [dice.uniform(-0.2, 1) for _ in range(6)], dice.choice([0, 0, 0, 1, 2, 3])) for i in range(90)]
    rows += [(100 + i, [0.5] * 6, i % 4) for i in range(40)]
    rows += [(200, None, 1), (201, [0.5, None, 1.0, 1.0, 1.0, 1.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 0), (204, [1.0] * 6, None), (None, [1.0] * 6, 0)]
    rows += [(7, [0.9] * 6, 0), (7, [0.9] * 6, 0), (14, [0.9] * 6, 3), (210, [], 0), (211, [0.7, 0.7], 0), (217, [-1.0] * 6, 1), (218, [0.0] * 6, 1)]
    return rows


@pytest.mark.parametrize(("tile_anchors", "tile_rows"), [(4096, 32_768), (3, 11)])
def test_mined(tile_anchors, tile_rows, spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", tile_anchors)
    monkeypatch.setattr(hn, "ROWS", tile_rows)
    given = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in cases()], SHAPE).repartition(3)
    rows = hn.prepared(given)
    found = hn.mine(rows, rows.where(F.col("vec_id") % 7 == 0))
    assert sorted(tuple(r) for r in found.collect()) == brute(cases())


@pytest.mark.parametrize("size", [1e4, 1e9, 3e30])
def test_large_components(size, spark):
    dice = random.Random(int(size) % 97)
    given = [(i, [dice.uniform(0, size) for _ in range(4)], i % 2) for i in range(30)]
    rows = hn.prepared(spark.createDataFrame([(*r, None, None, None, None) for r in given], SHAPE))
    found = hn.mine(rows, rows.where(F.col("vec_id") % 7 == 0))
    assert sorted(tuple(r) for r in found.collect()) == brute(given)


def test_no_rows_no_anchors_one_label(spark):
    given = spark.createDataFrame([(i, [1.0, 0.5], 1, None, None, None, None) for i in range(1, 7)], SHAPE)
    rows = hn.prepared(given)
    assert hn.mine(rows.limit(0), rows.limit(0)).count() == 0
    assert hn.mine(rows, rows.where("vec_id > 100")).count() == 0
    assert hn.mine(rows, rows).count() == 0


def test_query_equals_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    assert sorted(tuple(r) for r in hn.op13_hard_negatives(spark, sf).collect()) == sorted(c.execute(hn.OP13_SQL).fetchall())
