"""Joins of documents with documents, and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import near_duplicates, substrings
from quantloom.llm.components import components


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = defaultdict(int)
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                common[h[y], h[x]] += 1
    for (x, y), c in common.items():
        if 100 * c >= 80 * (len(sets[x]) + len(sets[y]) - c):
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = rng.choice([[], [f"edit{rng.random()}"]])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "a", "A", "one two three", "one two three four five", "One two three four five six"]
    common = [f"c{i}" for i in range(60)]
    for size in [6, 8, 9, 10, 12, 14, 18, 25, 33, 40, 60, 90, 150, 400]:
        for k in range(3):
            texts += family(rng, [f"w{size}.{k}.{i}" for i in range(size)], 5, max(1, size // 20))
        texts += [" ".join(common[: 40] + [f"u{size}.{j}.{i}" for i in range(size)]) for j in range(12)]
    texts += family(rng, [f"big{i}" for i in range(120)], 40, 4)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    given = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.link(given.selectExpr("*", "1 as node", "2 as k", "3 as label")).collect()}
    assert got == brute_components(rows)


def test_jaccard_by_the_last_step_alone(spark, monkeypatch):
    """No partner is tried first: the complete step finds every link."""
    monkeypatch.setattr(near_duplicates, "ROUNDS", 1)
    none = lambda rows: rows.select(rows.node.alias("a"), rows.node.alias("b")).limit(0)
    monkeypatch.setattr(near_duplicates, "with_smallest", none)
    monkeypatch.setattr(near_duplicates, "with_family", none)
    rng = random.Random(5)
    texts = [t for k in range(12) for t in family(rng, [f"w{k}.{i}" for i in range(8 + 9 * k)], 9, 1 + k)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_of_equal_small_sets(spark):
    """Word sequences that differ, of one, two and three shingles that don't."""
    texts = ["a a a a a", "a a a a a a a", "x y x y x y", "y x y x y x y x", "p q r p q r p", "q r p q r p q r", "p q r p q r"]
    rows = list(enumerate(texts))
    found = near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


@pytest.mark.parametrize(("low", "both", "left", "right"), [(0, 8, 2, 0), (0, 18, 2, 2), (1, 30, 3, 4), (1, 34, 4, 4)])
def test_linked_sets_meet_whatever_segments_are_empty(low, both, left, right):
    """Sets whose shingles lie in few segments, the differing ones among them."""
    top, _, _, segments, _ = near_duplicates.bands()
    n = both + max(left, right)
    band = int(np.searchsorted(top, n))
    salt = near_duplicates.mix(np.arange(len(top), dtype=np.uint64) + np.uint64(77))[band]
    tokens = np.arange(1, 400_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = (near_duplicates.mix(tokens + salt) % np.uint64(segments[band])).astype(int)
    # One segment for a small band; for a larger one as many as shingles that differ, each of which spoils its own.
    used = range(left + right) if low else [0]
    pools = [list(tokens[at == k][:60]) for k in used]
    x, y = set(), set()
    for k in range(left):
        x.add(pools[k % len(pools)].pop())
    for k in range(right):
        y.add(pools[(left + k) % len(pools)].pop())
    for k in range(both):
        t = pools[k % len(pools)].pop()
        x.add(t), y.add(t)
    assert 10 * len(x & y) >= 8 * len(x | y)
    h = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (x, y)])
    key, doc, loss = near_duplicates.signatures(h, np.array([0, len(x), len(x) + len(y)]))
    met = [set(key[(doc == d) & (loss < 0)].tolist()) for d in (0, 1)]
    assert met[0] & met[1]


def test_jaccard_of_several_texts_under_one_id(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(1, a), (2, b), (3, a), (3, b), (3, b), (4, c), (5, c), (5, c)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_jaccard_of_nothing(spark):
    assert near_duplicates.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "no id here at all"), (4, None)]
    got = {r.doc_id: r.component_id for r in near_duplicates.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: None, 4: 4}


def test_keep_first(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words here"), (3, "other words here"), (None, "x"), (5, None)]
    kept = near_duplicates.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_passages(spark):
    rng = random.Random(2)
    fresh = lambda n: [f"x{rng.random()}" for _ in range(n)]
    passage = fresh(70)
    edited = passage[:30] + ["changed"] + passage[31:]
    texts = [fresh(50) + passage + fresh(20), fresh(10) + edited + fresh(60), passage, fresh(90), fresh(39), passage[:30], None, []]
    rows = [(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in substrings.passages(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].start, got[1].length, got[1].n_equal, got[1].others) == (10, 70, 69, [0])
    assert (got[2].start, got[2].length, got[2].others) == (0, 70, [0])
    left = {r.doc_id: r.text for r in substrings.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[2] == "" and len(left[1].split()) == 70 and left[0] == rows[0][1] and left[6] is None


def test_chain_crosses_gaps_in_order():
    import numpy as np

    a = np.array([0, 5, 40, 45, 90])
    assert substrings.chain(a, a + 3) == [(0, 98, 3, 101)] or len(substrings.chain(a, a + 3)) <= 2
    mixed = substrings.chain(np.array([0, 10, 20]), np.array([500, 10, 900]))
    assert len(mixed) == 3


def test_passages_beside_foreign_words(spark):
    """Two passages with other words between them in each text are two; after a long one, what is near still links."""
    rng = random.Random(3)
    fresh = lambda n: [f"x{rng.random()}" for _ in range(n)]
    p, q = fresh(50), fresh(50)
    rows = [(i, " ".join(fresh(9) + p + fresh(35) + q + fresh(9))) for i in range(2)]
    got = sorted((r.doc_id, r.start, r.length) for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 9, 50), (1, 94, 50)]


def test_chain_reaches_the_near_predecessor():
    import numpy as np

    long, near = np.arange(0, 500, 5), np.array([700, 705, 720, 725])
    found = substrings.chain(np.concatenate([long, near]), np.concatenate([long, near[:2], near[2:] + 8]))
    assert sorted((c[0][0], c[-1][1] - substrings.K) for c in found) == [(0, 495), (700, 725)]


@pytest.mark.parametrize("how", ["replace", "insert", "delete"])
def test_passages_edited_evenly(spark, how):
    """One word in five to twenty is edited: brute force knows the copies, and all of them are found whole."""
    rng = random.Random(7)
    fresh = lambda n: [f"x{rng.random()}" for _ in range(n)]
    rows, wanted = [], {}
    for n, every in enumerate([5, 6, 8, 10, 14, 20] if how == "replace" else [6, 8, 10, 14, 20]):
        p = fresh(60)
        q = [v for k, w in enumerate(p) for v in ([w] if (k + 1) % every else {"replace": ["new%d" % k], "insert": [w, "new%d" % k], "delete": []}[how])]
        while q[-1] not in p:
            q.pop()
        rows += [(2 * n, " ".join(fresh(7) + p + fresh(30))), (2 * n + 1, " ".join(fresh(11) + q + fresh(25)))]
        wanted[2 * n + 1] = (11, len(q), [2 * n])
    got = {r.doc_id: (r.start, r.length, r.others) for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(wanted)
    for i, (start, length, others) in wanted.items():
        assert got[i][2] == others and got[i][0] - start <= 9 and start + length - got[i][0] - got[i][1] <= 9, (i, got[i], wanted[i])


def test_passage_whose_seeds_are_held_elsewhere(spark):
    """Earlier documents hold every short seed of a passage amid other words; a later pair has it word for word."""
    rng = random.Random(8)
    fresh = lambda n: [f"x{rng.random()}" for _ in range(n)]
    p = fresh(44)
    texts = [fresh(20) + p[i : i + 10] + fresh(40) for i in range(0, 44)] + [fresh(12) + p + fresh(9), fresh(21) + p + fresh(5)]
    got = {r.doc_id: r for r in substrings.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert set(got) == {45} and (got[45].start, got[45].length) == (21, 44) and 44 in got[45].others


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from quantloom.llm.common import written

    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1]
    placed = corpus_pipeline.run(spark, sf)
    assert placed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
