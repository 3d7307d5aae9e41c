"""Entity linking against loops: masking, both ways of finding aliases, candidates, features, the reranker."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quantloom.operators import linking as L
from quantloom.operators import vectors as V

ALIASES = ["abc", "abcd", "bc", "cd", "a", "贵州茅台", "茅台", "", "dd", None]


def greedy(text, aliases):
    """Longest first; the first place that is left is masked."""
    body, out = list(text), []
    for alias in sorted({a for a in aliases if a}, key=lambda a: (-len(a), a)):
        at = "".join(body).find(alias)
        if at >= 0:
            out.append(alias)
            body[at : at + len(alias)] = "\0" * len(alias)
    return out


@pytest.mark.parametrize("most", [200_000, 1])
def test_contained_and_masked(most, spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_ALIASES", most)
    dice = random.Random(2)
    texts = ["".join(dice.choices("abcdd x茅台", k=dice.randint(0, 14))) for _ in range(80)] + [None, "abcdabc", "贵州茅台和茅台", "abcdabc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    names = spark.createDataFrame([(a,) for a in ALIASES], "alias string")
    plain = {r.id: sorted(r.found) for r in L.contained(rows, names, "body", "alias", "found").collect()}
    assert plain == {i: [] if t is None else sorted({a for a in ALIASES if a is not None and a in t}) for i, t in enumerate(texts)}
    masked = {r.id: r.found for r in L.contained(rows, names, "body", "alias", "found", masked=True).collect()}
    assert masked == {i: [] if t is None else greedy(t, ALIASES) for i, t in enumerate(texts)}
    assert L.contained(rows.limit(0), names, "body", "alias", "found").count() == 0
    assert all(r.found == [] for r in L.contained(rows, names.limit(0), "body", "alias", "found").collect())


def test_resolve(spark):
    codes = ["600519.SH", "000001.SZ", "300750.SZ", "600000.SH"]
    pairs = [("abcd", "300750.SZ"), ("abc", "600000.SH"), ("x", codes[0]), ("x", codes[1]), ("x", codes[2]), ("x", codes[3])]
    asked = ["abcd 600519.sh and 000001", "abc x1600519", "x", "300750.SZX 300750", None, "600519.SH abcd 600519"]
    got = L.resolve(spark.createDataFrame(list(enumerate(asked)), "id int, q string"), spark.createDataFrame([(c,) for c in codes], "ts_code string"), spark.createDataFrame(pairs, "alias string, ts_code string"), "id", "q")
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.id, r.place)):
        by.setdefault(r.id, []).append(r.entity)

    def brute(t):
        out = [m[0].upper() for m in re.finditer(r"(?i)\b[036]\d{5}\.(?:SH|SZ)\b", t)]
        out += [next(c for c in codes if c[:6] == m[0]) for m in re.finditer(r"(?<!\d)[036]\d{5}(?!\d)", t) if any(c[:6] == m[0] for c in codes)]
        out += [c for a in greedy(t, [p[0] for p in pairs]) for c in sorted(c for b, c in pairs if b == a)[:3]]
        return list(dict.fromkeys(c for c in out if c in codes))

    assert by == {i: brute(t) for i, t in enumerate(asked) if t and brute(t)}


@pytest.mark.parametrize("tile", [32_768, 5])
def test_top_k_in_tiles(tile, spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", tile)
    monkeypatch.setattr(V, "QUERIES", tile)
    dice = np.random.default_rng(1)
    data = dice.normal(size=(60, 8))
    data[10] = data[11] = 0
    data[20] = data[21]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, v array<double>")
    got = {(r.query_id, r["rank"]): (r.row_id, r.score) for r in V.top_k(rows.where("id < 23"), rows, "id", "v", 4).collect()}
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    cos = np.round((data / np.where(norm > 0, norm, 1)) @ (data / np.where(norm > 0, norm, 1)).T, 9)
    expected = {(q, n + 1): (i, cos[q, i]) for q in range(23) for n, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-cos[q, i], i))[:4])}
    assert got.keys() == expected.keys() and all(got[k][1] == pytest.approx(expected[k][1], abs=2e-9) for k in got)
    assert V.top_k(rows.limit(0), rows, "id", "v", 4).count() == 0


def test_flavour(spark):
    rows = spark.createDataFrame([("any NEWS today",), ("top sector",), ("news of the sector",), ("else",), (None,)], "q string")
    assert [r[0] for r in rows.select(L.flavour(rows.q, ["news"], ["sector"])).collect()] == ["news", "entity", "neutral", "neutral", "neutral"]


def test_reranker_learns_what_the_features_say(spark):
    dice = random.Random(4)
    rows = []
    for i in range(600):
        label = int(dice.random() < 0.2)
        rows.append((i, i % 7, label, float(label and dice.random() < 0.9), float(label * 2), 0.3 * label + dice.random() * 0.5, 5.0, 2.0))
    frame = spark.createDataFrame(rows, "doc_id long, entity long, label int, lex_title double, lex_content double, cos double, log_content double, log_title double")
    model, held = L.train_reranker(frame)
    held = held.collect()
    assert 30 < len(held) < 200 and sum((r.p >= 0.5) == bool(r.label) for r in held) > 0.95 * len(held)
    assert model.coefficients[FEATURE_COS] > 0
    with pytest.raises(ValueError, match="both labels"):
        L.train_reranker(frame.where("label = 0"))


FEATURE_COS = L.FEATURES.index("cos")


def test_texts_go_to_python_a_few_megabytes_at_a_time(spark):
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        texts = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("x abc "), 1000).alias("body"))
        found = L.contained(texts, spark.createDataFrame([("abc",)], "alias string"), "body", "alias", "found")

        @F.pandas_udf("long")
        def held(column):
            return column.map(len).cumsum()

        assert found.select(F.max(held("body"))).first()[0] <= L.BATCH_BYTES + 6000
        assert found.where(F.size("found") == 1).count() == 3000
        spark.conf.set(key, "1000")
        L.lean(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
