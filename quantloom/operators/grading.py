"""Checks of answers against golden cases, repetition in texts, suspicious entries of a history of names."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repetition(text: Column, n: int = 8, least: int = 3) -> Column:
    """The distinct runs of ``n`` characters, white space left out, that a text holds ``least`` times or more; 0 for null.

    A text is counted where it lies: as rows, its runs would be ``n`` times as large as it.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        bare = texts.fillna("").str.replace(r"\s+", "", regex=True)
        return pd.Series([sum(c >= least for c in Counter(t[i : i + n] for i in range(len(t) - n + 1)).values()) for t in bare], dtype="int64")

    return count(text)


def hedged(text: Column, phrases: list[str]) -> Column:
    """Whether a text says that it can't say."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases]), F.lit(False))


def figures(text: Column) -> Column:
    """The decimal numbers in a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def dated(text: Column) -> Column:
    """How many dates in brackets a text holds, one for each piece of news it cites."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[0-9]{4}-[0-9]{2}-[0-9]{2}\]"), F.lit(0)))


def graded(cases: DataFrame, answers: DataFrame, id_: str = "case_id") -> DataFrame:
    """(id, passed, reasons): golden cases against answers; a check that a case doesn't name (null) isn't made.

    Cases: ``all_of`` and ``any_of`` (arrays of ids), ``least_chars`` (50 if
    null), ``figure`` and ``tolerance`` (0.1 if null), ``least_news``.  Answers: ``answer`` and ``ids``.  A
    case without an answer is graded on an empty one.
    """
    none = F.array().cast("array<string>")
    j = cases.join(answers.select(id_, "answer", "ids"), id_, "left").withColumns({"answer": F.coalesce("answer", F.lit("")), "ids": F.coalesce("ids", none)})
    near = F.exists(figures(F.col("answer")), lambda x: F.abs(x - F.col("figure")) <= F.coalesce("tolerance", F.lit(0.1)))
    faults = {
        "missing ids": F.size(F.array_except("all_of", "ids")) > 0,
        "none of the ids": ~F.arrays_overlap("any_of", "ids"),
        "too short": F.length("answer") < F.coalesce("least_chars", F.lit(50)),
        "no such figure": F.col("figure").isNotNull() & ~near,
        "too few news": dated(F.col("answer")) < F.col("least_news"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in faults.items()]))
    return j.select(id_, (F.size(found) == 0).alias("passed"), found.alias("reasons"))


def suspicious(changes: DataFrame, words: list[str], key: str = "ts_code", at: str = "start_date", reason: str = "reason") -> DataFrame:
    """Changes whose reason holds one of the words, one row per key, date and reason: the one announced first."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.col(reason), F.lit(w)) for w in words])
    others = [c for c in changes.columns if c not in (key, at, reason)]
    rows = changes.where(F.coalesce(hit, F.lit(False)))
    return rows.groupBy(key, at, reason).agg(F.min(F.struct(*others)).alias("_o")).select(key, at, reason, *[F.col(f"_o.{c}").alias(c) for c in others]) if others else rows.select(key, at, reason).distinct()
