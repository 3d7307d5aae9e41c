"""Hard negatives for contrastive training: per anchor and positive, the best rows of other labels within a window of scores.

The windows of an anchor's positives overlap: all are cut from the same
descending order of scores.  The positives' scores, their upper limits, cut the scores into
disjoint slots; combiners keep the best k of each slot, and a window's answer
is the suffix of the slots from its own on, in descending order, down to its
lower limit.  Anchors meet all rows in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, written

#: Anchors and rows of a tile, and scores that a tile holds at a time.
ANCHORS = 4096
ROWS = 32_768
SCORES = 1 << 21
#: Windows reach from this many hundredths of the positive's score up to the score.
LOWER = 80
INT64 = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector has no null, infinite or undefined component and isn't null itself."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component as float64, shorter vectors filled up with zeros."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    flat = np.floor(256 * vectors.values.to_numpy(zero_copy_only=False).astype(np.float64))[offsets[0] : offsets[-1]]
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def width_of(vectors: pa.Array) -> int:
    lengths = np.diff(vectors.offsets.to_numpy())
    return int(lengths.max()) if len(lengths) else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b; what a long can't hold becomes its nearest end."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(x) for x in row] for row in b.tolist()]
    exact = [[sum(int(x) * y for x, y in zip(row, other, strict=True)) for other in whole] for row in a.tolist()]
    return np.array([[min(max(v, INT64.min), INT64.max) for v in row] for row in exact], np.int64).reshape(len(a), len(b))


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by descending score, then by id."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[nth < k]


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, each id once: of several rows, the one of the least label and vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return one.select("vec_id", "r.label", "r.embedding")


def flipped(vec_id: Column, label: Column) -> Column:
    """The label, moved on by one of ten where 7 divides the id."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def dealt(df: DataFrame, id_: str, size: int, name: str) -> tuple[DataFrame, int]:
    """``df`` with a tile number by hash of the id, and the number of tiles.

    A tile holds about ``size`` rows; of a table of few tiles, down to a
    sixteenth of that, so that there is work for all tasks.
    """
    rows = df.count()
    n = max(1, -(-rows // size), min(shuffle_parts(df), -(-rows * 16 // size)))
    return df.withColumn(name, F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")), n


def tiles(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(anchors, rows)`` on every tile of anchors with every tile of rows.

    Anchors are the stated query set.  Either side goes once to each tile of
    the other, so a task holds one tile of each, whatever the table's size.
    """
    left, m = dealt(anchors, "anchor_id", ANCHORS, "anchor_tile")
    right, n = dealt(rows, "vec_id", ROWS, "row_tile")
    left = left.withColumn("row_tile", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = right.withColumn("anchor_tile", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    keys = ["anchor_tile", "row_tile"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple:
    a, b = anchors.combine_chunks(), rows.combine_chunks()
    va, vb = (t.column(c).combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float32())) for t, c in ((a, "anchor_vector"), (b, "embedding")))
    width = max(width_of(va), width_of(vb))
    column = lambda t, c: t.column(c).to_numpy() if t.num_rows else np.empty(0, np.int64)
    return a, column(a, "anchor_id"), column(a, "anchor_label"), numbers(va, width), column(b, "vec_id"), column(b, "label"), numbers(vb, width)


def _parts(n: int, each: int):
    step = max(1, SCORES // max(each, 1))
    return ((low, min(low + step, n)) for low in range(0, n, step))


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positives): the first k other rows of the anchor's label as structs (score, positive_id), best first."""

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        _, ids, labels, a, row_ids, row_labels, b = _sides(one, other)
        out = []
        for low, high in _parts(len(ids), len(row_ids)):
            score = products(a[low:high], b)
            i, j = np.nonzero((labels[low:high, None] == row_labels) & (ids[low:high, None] != row_ids))
            s = score[i, j]
            pick = best(i, s, row_ids[j], k)
            out.append((ids[low:high][i[pick]], row_ids[j[pick]], s[pick]))
        found = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 3)]
        return pa.table({"anchor_id": found[0], "positive_id": found[1], "score": found[2]})

    met = tiles(anchors, rows, run, "anchor_id long, positive_id long, score long")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    first = met.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "positive_id"))).alias("positives"))


def slotted(anchors: DataFrame, rows: DataFrame, k: int, lower: int) -> DataFrame:
    """(anchor_id, slot, score, negative_id): the best k rows of other labels in each slot of each anchor.

    ``anchors`` have ``limits``, their positives' scores in descending order.
    Slot s holds the scores from limit s down to above the next limit that
    differs; the last reaches down to the lowest lower limit of all.
    """

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        left, ids, labels, a, row_ids, row_labels, b = _sides(one, other)
        caps = left.column("limits").to_pylist() if left.num_rows else []
        wide = max(map(len, caps), default=1)
        # Repeated last limits make no further slots; the numbers stay in the range of a long.
        limits = np.array([c + [c[-1]] * (wide - len(c)) for c in caps], np.int64).reshape(len(ids), wide)
        floor = np.array([-((-c[-1] * lower) // 100) for c in caps], np.int64)
        out = []
        for low, high in _parts(len(ids), len(row_ids)):
            score = products(a[low:high], b)
            i, j = np.nonzero((labels[low:high, None] != row_labels) & (score <= limits[low:high, :1]) & (score >= floor[low:high, None]))
            s = score[i, j]
            slot = (s[:, None] <= limits[low:high][i]).sum(1) - 1
            pick = best(i * wide + slot, s, row_ids[j], k)
            out.append((ids[low:high][i[pick]], slot[pick], s[pick], row_ids[j[pick]]))
        found = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table({"anchor_id": found[0], "slot": found[1].astype(np.int32), "score": found[2], "negative_id": found[3]})

    met = tiles(anchors, rows, run, "anchor_id long, slot int, score long, negative_id long")
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "negative_id")
    return met.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, lower: int = LOWER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` have vec_id, label and embedding, each id once
    (see ``prepared``); anchors are among the rows.  Components become
    floor(256 x), scores are integer inner products; missing components of shorter vectors count as 0, scores outside
    the range of a long as its nearest end.  Higher scores come first, ties by smaller id.  Per anchor
    and positive: the first ``n_negatives`` rows of other labels with
    lower% of the positive's score <= score <= the positive's score, all if
    fewer.  Anchors without positives or negatives have no rows; a negative
    positive score has no window.
    """
    queries = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("embedding").alias("anchor_vector"))
    found = written(positives(queries, rows, n_positives))
    limited = queries.join(found.select("anchor_id", F.transform("positives", lambda p: p["score"]).alias("limits")), "anchor_id")
    kept = slotted(limited, rows, n_negatives, lower)
    merged = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "negative_id", "slot", "score"))).alias("slots"))
    each = found.join(merged, "anchor_id").withColumn("p", F.explode("positives"))
    upper = F.col("p.score").cast("decimal(38,0)")
    suffix = F.filter("slots", lambda x: (x["score"] <= F.col("p.score")) & (x["score"].cast("decimal(38,0)") * 100 >= upper * lower))
    answers = each.select("anchor_id", "p", F.posexplode(F.slice(suffix, 1, n_negatives)).alias("at", "x"))
    return answers.select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.negative_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"),
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings`` for the anchors whose vec_id is divisible by 100."""
    rows = written(prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("label", flipped(F.col("vec_id"), F.col("label"))))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """with given as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v,
         row_number() over (partition by vec_id order by label, embedding) as n
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
r as (select vec_id, label, v from given where n = 1),
scores as (
  select a.vec_id as anchor_id, b.vec_id as row_id, a.label = b.label as same,
         cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (
  select anchor_id, row_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, row_id) as k from scores where same) x where k <= 5),
met as (
  select p.anchor_id, positive_id, row_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, row_id) as k
  from positive p join scores s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, cast(k as integer) as rank, negative_id, positive_score, negative_score from met where k <= 5"""
