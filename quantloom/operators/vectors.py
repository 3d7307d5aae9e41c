"""Vectors: normalisation, dot products, top-k by cosine against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a tile, and scores that a task holds at a time.
QUERIES, ROWS, SCORES = 4096, 32_768, 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    x = np.array([r if r is not None else [] for r in rows], np.float64).reshape(len(rows), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``df`` with a tile number by hash of the id, about ``size`` rows a tile; of a small table, fewer, so that all tasks have work."""
    n, parts = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-n // size), min(parts, -(-n * 16 // size)))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")), tiles


def top_k(queries: DataFrame, rows: DataFrame, id_: str, vector: str, k: int, least: float = -1.0, others: bool = True) -> DataFrame:
    """(query_id, row_id, score, rank) of the k rows of largest cosine for every query, ties by id; ``others`` leaves out the query's own id.

    The stated query set meets all rows in tiles of bounded size, each a matrix
    product in one task; k per query and tile are kept, and one small shuffle merges them.
    Null vectors are zero vectors; several rows of one id count each.
    """
    left, m = _dealt(queries.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")), QUERIES, "query_tile")
    right, n = _dealt(rows.select(F.col(id_).cast("long").alias("row"), F.col(vector).alias("row_vector")).withColumn("id", F.col("row")), ROWS, "row_tile")
    left = left.withColumn("row_tile", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = right.drop("id").withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        ids, found = one.column("id").to_numpy() if one.num_rows else np.empty(0, np.int64), []
        if one.num_rows and other.num_rows:
            a, b, row = _matrix(one.column("vector")), _matrix(other.column("row_vector")).T, other.column("row").to_numpy()
            step = max(1, SCORES // len(row))
            for low in range(0, len(ids), step):
                score = np.round(a[low : low + step] @ b, 9)
                if others:
                    score[ids[low : low + step, None] == row[None, :]] = -np.inf
                score[score < least] = -np.inf
                order = np.lexsort((np.broadcast_to(row, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                good = np.isfinite(best)
                found.append((np.broadcast_to(ids[low : low + step, None], best.shape)[good], row[order][good], best[good]))
        q, r, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": q, "row_id": r, "score": s})

    keys = ["query_tile", "row_tile"]
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, row_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
