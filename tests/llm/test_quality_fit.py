"""The classifier is fitted on every passage of a labelled document."""

from __future__ import annotations

from quantloom.llm import quality


def test_fit_takes_all_passages(spark, monkeypatch):
    texts = [(i, " ".join(f"w{i}.{k}" for k in range(quality.PASSAGE * 100))) for i in range(4)]
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, bounds, target: seen.append((len(x), len(bounds) - 1)) or self)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"))
    assert seen == [(400, 4)]
