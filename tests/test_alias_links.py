"""Aliases are found at any character of a text."""

from __future__ import annotations

from quantloom.operators import linking


def test_aliases_inside_words_after_marks_and_without_spaces(spark):
    names = ["Name", "long name of a fund whose", "贵州茅台", "x😀y", "a.b", "", "nowhere", None]
    bodies = ["a 'Name, he said", "preName5", "(long name of a fund whosever", "今天贵州茅台上涨", "line\nax😀yb", "aXb", "a.b", "", None]
    texts = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    aliases = spark.createDataFrame(list(enumerate(names)), "no int, name string")
    got = sorted((r.id, r.no) for r in linking.link_aliases(texts, aliases, "body", "name").collect())
    assert got == [(i, n) for i, b in enumerate(bodies) for n, a in enumerate(names) if a is not None and b is not None and a in b]
