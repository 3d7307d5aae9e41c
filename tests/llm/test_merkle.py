"""Merkle manifests against trees built with lists, and against SQL."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(levels, i, acc, sides):
    for level in levels[:-1]:
        low = i // 8 * 8
        run = level[low : low + 8]
        left, right = run[: i - low], run[i - low + 1 :]
        sides += left + right
        acc, i = h(*left, acc, *right), i // 8
    return acc


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for d, source, lang, n, text in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        seen = text.translate(LOW) if text is not None and hit else text
        groups.setdefault(lang, []).append((d, h(*map(field, (d, source, lang, n, text))), h(*map(field, (d, source, lang, n, seen)))))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: tree([leaf for _, leaf, _ in g]) for k, g in groups.items()}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for place, k in enumerate(order):
        for i, (d, leaf, seen) in enumerate(groups[k]):
            sides = []
            root = climb(top, place, climb(trees[k], i, seen, sides), sides)
            out.append((d, leaf, trees[k][-1][0], top[-1][0], h(*sides), root, root == top[-1][0]))
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


ROWS = [(i * 3, "web", "en", i, f"Text Number {i} É") for i in range(75)] + [(500 + i, None, f"l{i:02d}", None, "ABC") for i in range(11)]
ROWS += [(9, None, None, None, None), (None, "a", None, 1, ""), (None, "a", None, 1, ""), (12, "a", "ü", 5, "X" * 200_000), (12, "a", "ü", 5, "X" * 200_000), (12, "b", "ü", 5, "y")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:8], ROWS[:9], ROWS[:64] + ROWS[80:81]])
def test_manifest(rows, spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest int, idx int, key int").repartition(5)
    found = merkle.manifest(docs, changed=merkle.tampered(F.col("doc_id"), F.col("text")))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert plain(found.collect()) == plain(brute(rows))


def test_no_rows_and_no_changes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs.limit(0)).count() == 0
    assert merkle.manifest(docs.where("n_chars < 10")).where("not verified").count() == 0


def test_query_equals_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert plain(merkle.op12_merkle(spark, sf).collect()) == plain(c.execute(merkle.OP12_SQL).fetchall())
