"""Queries on repetition, golden cases and suspicious changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading as G
from .base import query

# What a text says that can't say, and the reasons of a change that may mark another company.
HEDGES = ["the the", "que que", "of of"]
REASONS = ["URGENT", "HIGH"]


@query("f11_repetition")
def f11(T):
    """Runs of eight characters that a text repeats, and whether it hedges; SQL takes seconds for a thousand texts, so a test by loops stands for it."""
    return T("news").select("doc_id", G.repetition(F.col("content")).alias("repeats"), G.hedged(F.col("content"), HEDGES).alias("hedged"))


@query("f24_golden_cases", """with k as (select doc_id as case_id, content as answer, [source, lang_] as ids from (select n.*, d.lang as lang_ from news n join documents d on d.doc_id = n.doc_id) x where doc_id % 11 <> 0),
c as (select doc_id as case_id, case when doc_id % 3 = 0 then ['en'] end as all_of, case when doc_id % 5 = 0 then ['src1', 'src2', 'de'] end as any_of, case when doc_id % 2 = 0 then 400 end as least_chars, case when doc_id % 4 = 0 then 1e1 end as figure, case when doc_id % 8 = 0 then 5e0 end as tolerance, case when doc_id % 50 = 0 then 1 end as least_news from documents),
j as (select c.*, coalesce(k.answer, '') as answer, coalesce(k.ids, []) as ids from c left join k on k.case_id = c.case_id),
r as (select case_id, [case when len(list_filter(all_of, lambda x: not list_contains(ids, x))) > 0 then 'missing ids' end, case when any_of is not null and not list_has_any(any_of, ids) then 'none of the ids' end, case when length(answer) < coalesce(least_chars, 50) then 'too short' end,
  case when figure is not null and len(list_filter(regexp_extract_all(answer, '-?[0-9]+(\\.[0-9]+)?'), lambda x: abs(cast(x as double) - figure) <= coalesce(tolerance, 1e-1))) = 0 then 'no such figure' end, case when len(regexp_extract_all(answer, '\\[[0-9]{4}-[0-9]{2}-[0-9]{2}\\]')) < least_news then 'too few news' end] as a from j)
select case_id, len(list_filter(a, lambda x: x is not null)) = 0 as passed, array_to_string(list_filter(a, lambda x: x is not null), ', ') as reasons from r""")
def f24(T):
    """Documents as answers to cases that ask for ids, length, a figure and news."""
    d = T("documents").select(F.col("doc_id").alias("case_id"), "lang")
    only = lambda n, v: F.when(F.col("case_id") % n == 0, v)
    cases = d.select(
        "case_id", only(3, F.array(F.lit("en"))).alias("all_of"), only(5, F.array(F.lit("src1"), F.lit("src2"), F.lit("de"))).alias("any_of"), only(2, F.lit(400)).alias("least_chars"), only(4, F.lit(10.0)).alias("figure"),
        only(8, F.lit(5.0)).alias("tolerance"), only(50, F.lit(1)).alias("least_news"),
    )
    answers = T("news").select(F.col("doc_id").alias("case_id"), "source", F.col("content").alias("answer")).where("case_id % 11 <> 0").join(d, "case_id").withColumn("ids", F.array("source", "lang"))
    return G.graded(cases, answers).select("case_id", "passed", F.array_join("reasons", ", ").alias("reasons"))


@query("p07_suspicious", "select ts_code, start_date, reason, ann_date from (select c.ts_code, cast(o_orderdate as date) as start_date, o_orderpriority as reason, min(cast(o_orderdate as date) + 3) as ann_date from orders join codes c on c.l_suppkey = o_custkey % 100 where contains(o_orderpriority, 'URGENT') or contains(o_orderpriority, 'HIGH') group by 1, 2, 3) x")
def p07(T):
    """Changes of a suspicious reason, each once."""
    o = T("orders").join(T("codes"), F.col("l_suppkey") == F.col("o_custkey") % 100)
    changes = o.select("ts_code", F.to_date("o_orderdate").alias("start_date"), F.col("o_orderpriority").alias("reason"), F.date_add(F.to_date("o_orderdate"), 3).alias("ann_date"))
    return G.suspicious(changes, REASONS)
