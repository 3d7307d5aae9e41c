"""Mixing sources to target weights: floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, word_count

#: Hexadecimal digits of the coin; 13 of them are exact in a double.
COIN_DIGITS = 13


def source_sizes(docs: DataFrame) -> DataFrame:
    """(no_source, source_key, source_size): words per source, null sources as a source of their own."""
    return (
        docs.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), word_count(F.col("text")).alias("size"))
        .groupBy("no_source", "source_key")
        .agg(F.sum("size").alias("source_size"))
    )


def cyclic_weights(sizes: DataFrame, cycle=(3, 1, 2)) -> DataFrame:
    """Weights given in turn to the sources by code point, null last.

    Needs the rank of each source among all: one task orders one row per source.
    """
    rank = F.row_number().over(Window.orderBy("no_source", "source_key"))
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), ((rank - 1) % len(cycle) + 1).cast("int")).cast("long"))


def targets(weighted: DataFrame, budget_num: int = 3, budget_den: int = 2, cap: int = 2) -> DataFrame:
    """Share ``budget_num/budget_den`` of all words by weight, no source above ``cap`` times its words.

    In order of size/weight the capped sources come first; a source is capped
    if its cap is at most its share of what the earlier ones leave.  The test
    is in integers, so the result doesn't depend on rounding or order.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source_key")
    everything = Window.partitionBy()
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = budget_num * F.col("total") - budget_den * cap * F.col("earlier")
    step = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("earlier", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("left", left)
        .withColumn("capped", budget_den * cap * F.col("source_size") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    )
    level = F.min_by(F.struct("left", "weight_left"), F.when(~F.col("capped"), F.struct("earlier", -F.col("weight_left")))).over(everything)
    return step.withColumn("level", level).select(
        "no_source", "source_key", "source_size", "weight",
        F.when(F.col("capped"), (cap * F.col("source_size")).cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / (budget_den * F.col("level.weight_left")).cast("double"))
        .alias("target"),
    )


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, COIN_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**COIN_DIGITS))


def mix(docs: DataFrame, weights=cyclic_weights, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies; no row is dropped here.

    ``weights`` adds a positive integer ``weight`` to the table of sources.
    Null texts have size 0; a source without words has target 0; null sources
    are one source; equal ids fall alike.  Columns of those names in ``docs``
    are replaced.  An empty table gives an empty result.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    plan = small(cut(targets(weights(source_sizes(docs)))).select(
        F.col("no_source").alias("_no_source"), F.col("source_key").alias("_source_key"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target")))
    keyed = docs.drop(*added).withColumns({"_k0": F.col("source").isNull(), "_k1": F.coalesce("source", F.lit("")), "size": word_count(F.col("text"))})
    joined = keyed.join(plan, (F.col("_k0") == F.col("_no_source")) & (F.col("_k1") == F.col("_source_key")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return (
        joined.withColumns({"source_size": F.col("_source_size"), "target": F.col("_target"), "rate": rate})
        .withColumn("copies", (F.floor("rate") + (coin(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
        .drop("_k0", "_k1", "_no_source", "_source_key", "_source_size", "_target")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy")


def op7_mix(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, size, source_size, target and the words that the mix takes of it."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
with d as (
  select doc_id, source is null as no_source, coalesce(source, '') as source_key,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
s as (select no_source, source_key, cast(sum(size) as bigint) as source_size from d group by 1, 2),
w as (select *, cast([3, 1, 2][(row_number() over (order by no_source, source_key) - 1) % 3 + 1] as bigint) as weight from s),
o as (
  select *, cast(sum(source_size) over () as bigint) as total,
         cast(coalesce(sum(source_size) over (order by source_size / weight, no_source, source_key rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier,
         cast(sum(weight) over (order by source_size / weight, no_source, source_key rows between current row and unbounded following) as bigint) as weight_left
  from w),
c as (select *, 4 * source_size * weight_left <= weight * (3 * total - 4 * earlier) as capped from o),
l as (select 3 * total - 4 * earlier as lvl, weight_left as lvl_weight from c where not capped order by earlier, weight_left desc limit 1),
t as (
  select no_source, source_key, source_size,
         case when capped then cast(2 * source_size as double) else cast(weight * lvl as double) / cast(2 * lvl_weight as double) end as target
  from c left join l on true),
r as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
         cast(('0x' || substr(md5('7:' || coalesce(cast(d.doc_id as varchar), '')), 1, 13)) as bigint) / 4503599627370496e0 as coin
  from d join t using (no_source, source_key))
select doc_id, size, source_size, target,
       cast(size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from r
"""
