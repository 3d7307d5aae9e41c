"""Repeated passages: equal texts, several texts under one doc_id, packing, and growth of many chains at once."""

from __future__ import annotations

from collections import Counter

import numpy as np

from quantloom.llm import substrings


def _words(seed: int, n: int) -> list[str]:
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n)]


def test_packed_rows_come_back():
    rows = np.random.default_rng(1).integers(-(2**62), 2**62, (1000, 4))
    back = substrings._unpacked(substrings._packed(1, rows, 16).column(2), 4)
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, rows.tolist()))
    assert substrings._unpacked(substrings._packed(1, rows[:0], 16).column(2), 4).shape == (0, 4)


def test_parts_of_the_keys_make_up_all_seeds():
    texts = [" ".join(_words(2, 300)).encode(), b"", b"few words", " ".join(_words(3, 45)).encode()]
    whole = set(zip(*(x.tolist() for x in substrings.seeds(texts)), strict=True))
    parts = [set(zip(*(x.tolist() for x in substrings.seeds(texts, i, 4)), strict=True)) for i in range(4)]
    assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole)
    assert len(whole) == sum(3 * n - (7 + 8 + 39) for n in (300, 45))


def test_chains_grown_together_are_judged_as_each_alone():
    rng = np.random.default_rng(4)
    items = []
    for n in (30, 90, 700, 2000):
        x = rng.integers(2, 2**63, n).astype(np.uint64)
        y = np.where(rng.random(n) < 0.1, np.uint64(7), x)
        y[n // 2 : n // 2 + n // 8] = 9
        for at in range(0, n - 8, 11):
            items.append((x, y, np.array([[at, at + 8, at, at + 8]])))
    items.append((items[0][0], items[0][1], np.array([[0, 8, 0, 8], [20, 30, 20, 30]])))
    assert list(substrings.judge_many(items)) == [substrings.judge(*item) for item in items]
    assert list(substrings.judge_many([])) == []


def test_equal_texts_are_passages_as_a_whole(spark):
    text, other = " ".join(_words(5, 60)), " ".join(_words(6, 60))
    short = " ".join(_words(7, 39))
    rows = [(9, text), (3, text), (5, text), (1, short), (2, short), (4, None), (6, None), (7, ""), (8, ""), (None, text), (10, other), (10, "~" + text), (11, other)]
    got = {r.doc_id: (r.start, r.length, r.n_equal, r.others) for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Document 10 stands for its smaller text.
    first = min(other, "~" + text)
    assert first == other
    assert got == {5: (0, 60, 60, [3]), 9: (0, 60, 60, [3]), 11: (0, 60, 60, [10])}


def test_empty_table_has_no_passages(spark):
    assert substrings.passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_seeds_of_recurring_runs_are_the_seeds_that_recur():
    """Few words make many repeats: what the runs that recur join to holds every seed of two places; lone texts send short rows only."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(9)], n)).encode() for n in rng.integers(30, 90, 40)] + [" ".join(_words(9, 400)).encode()]
    h, doc, word = substrings.starts(texts)
    again, head = substrings._again(h)
    assert sorted(h[head].tolist()) == [x for x, n in sorted(Counter(h.tolist()).items()) if n > 1] and not again[doc == 40].any()
    kept, whole = (Counter(zip(*(x.tolist() for x in found), strict=True)) for found in (substrings.joined(h[again], doc[again], word[again]), substrings.seeds(texts)))
    times = Counter(key for key, _, _ in {(key, doc, spot // 2) for key, doc, spot in whole})
    assert {row for row in whole if times[row[0]] > 1} <= set(kept) <= set(whole) and max(kept.values()) == 1


def test_packed_rows_take_the_bytes_that_differ():
    rows = np.stack([np.arange(5000) % 7 + 2**40, np.arange(5000) + 10**12, np.full(5000, -3)], 1)
    packed = substrings._packed(0, rows, 4).column(2)
    assert sum(len(x.as_py()) for x in packed) <= 5000 * 4 + 4 * 48
    assert sorted(map(tuple, substrings._unpacked(packed, 3).tolist())) == sorted(map(tuple, rows.tolist()))


def test_words_in_common_are_those_of_the_table():
    rng = np.random.default_rng(10)
    for _ in range(200):
        x, y = (rng.integers(0, 12, n).astype(np.uint64) for n in rng.integers(1, 90, 2))
        row = np.zeros(len(y) + 1, np.int64)
        for v in x:
            row[1:] = np.maximum(row[1:], row[:-1] + (y == v))
            row = np.maximum.accumulate(row)
        assert substrings.align(x, y) in {int(row[-1]), int(np.count_nonzero(x == y)) if len(x) == len(y) else -1}


def test_a_word_that_follows_itself_is_no_repeat_of_its_own_place(spark):
    """Five equal words give one place two seeds with one key, whose halves another text has too."""
    a, b = _words(11, 60), _words(12, 60)
    rows = [(1, " ".join([*a[:30], "p", "q", "r", "s", *["la"] * 5, *a[30:]])), (2, " ".join([*b[:20], "p", "q", "r", "s", *b[20:]]))]
    assert substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
