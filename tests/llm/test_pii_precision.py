"""Patterns are trusted by their seeds and by what other trusted patterns find."""

from __future__ import annotations

import random

from quantloom.llm import pii

SHAPE = "pattern string, value string, kind int"


def test_a_pattern_does_not_vouch_for_itself(spark):
    rows = [(p, f"s{i}", 3) for p in ("A", "B") for i in range(45)] + [(p, f"u{i}", None) for p in ("A", "B") for i in range(55)]
    assert pii.score_patterns(spark.createDataFrame(rows, SHAPE)).count() == 0


def test_found_instances_support_new_patterns(spark):
    rows = [("A", f"s{i}", 0) for i in range(18)] + [("A", f"u{i}", None) for i in range(2)]
    rows += [("B", f"t{i}", 0) for i in range(4)] + [("B", "u0", None)]
    got = {r.pattern: (r.kind, round(r.score, 6), r.seeds) for r in pii.score_patterns(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got["B"] == (0, 0.98, 5) and got["A"][0] == 0


def test_secrets_where_patterns_hold_them(spark):
    """Hexadecimal keys teach a context, which then finds keys of other forms; the same words elsewhere are left alone."""
    rng = random.Random(11)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1"
    word = lambda: "".join(rng.choice("rstln") for _ in range(9))
    rows = [(i, f"{word()} {word()} token = \"{key()}\" {word()} {word()}") for i in range(20)]
    rows += [(20 + i, f"{word()} {word()} token = zq{i}7731xw{i} {word()}") for i in range(3)]
    rows += [(40 + i, f"{word()} {word()} {key()} {word()} {word()}") for i in range(5)] + [(60, f"{word()} 55{rng.random()} {word()}"), (61, None), (62, "")]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]) == 1 and got[i][0][0] == pii.SECRET for i in range(23))
    assert all(not got[i] for i in got if i >= 40)
