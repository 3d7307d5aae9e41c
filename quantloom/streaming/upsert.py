"""A keyed table that batches are merged into, each exactly once: changed buckets are written anew, a ledger says which version counts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table; a batch rewrites those that it touches.
BUCKETS = 16


class KeyedTable:
    """Rows by key under ``path``; the last to arrive counts.

    ``data/batch=<n>/bucket=<b>`` holds bucket b as batch n left it.
    ``ledger/batch=<n>`` lists the buckets of batch n and is written last: only
    then is the batch done.  A batch that is in the ledger is not merged again;
    what a broken batch left behind is overwritten when it is repeated, and
    never read.  Keys are compared as text, so that 20240105 and '20240105' are one key; a null
    key is a key of its own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path, schema, keys, order, buckets

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def done(self, number: int) -> bool:
        """Whether a batch is in the ledger; its folder counts once its writer has committed."""
        return self._exists(f"{self.path}/ledger/batch={number}/_SUCCESS")

    def current(self) -> dict[int, int]:
        """The batch that holds the current version of each bucket, of at most ``buckets``."""
        if not self._exists(f"{self.path}/ledger"):
            return {}
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        entries = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where)
        numbers = [int(e.getPath().getName().split("=")[1]) for e in entries if e.getPath().getName().startswith("batch=")]
        paths = [f"{self.path}/ledger/batch={n}" for n in numbers if self.done(n)]
        if not paths:
            return {}
        seen = self.spark.read.schema("bucket int, version int").parquet(*paths)
        return {r["bucket"]: r["version"] for r in seen.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def _key(self) -> list[Column]:
        return [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the table, or of some buckets."""
        held = self.current()
        paths = [f"{self.path}/data/batch={v}/bucket={b}" for b, v in held.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Merge a batch: its rows over the table's, its later ones (by ``order``) over its earlier ones; False if it was done before."""
        if self.done(number):
            return False
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        bucket = F.pmod(F.xxhash64(*self._key()), F.lit(self.buckets)).cast("int")
        new = batch.select(*names).withColumns({"_new": F.lit(1), "bucket": bucket}).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = self.read(touched).withColumns({"_new": F.lit(0), "bucket": bucket})
        w = Window.partitionBy("bucket", *self._key()).orderBy(F.desc("_new"), *[F.desc_nulls_last(c) for c in self.order])
        kept = old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        listed = self.spark.createDataFrame([(b, number) for b in touched], "bucket int, version int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={number}")
        new.unpersist()
        return True

    def vacuum(self) -> list[str]:
        """Delete the versions that no bucket needs any more; the folders deleted."""
        held, gone = self.current(), []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        where = path(f"{self.path}/data")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in (x.getPath() for x in fs.listStatus(where)):
            n = int(b.getName().split("=")[1])
            for v in (x.getPath() for x in fs.listStatus(b)):
                if v.getName().startswith("bucket=") and self.done(n) and held.get(int(v.getName().split("=")[1])) != n:
                    fs.delete(v, True)
                    gone.append(v.toString())
        return gone


def upsert_stream(stream: DataFrame, table: KeyedTable, state: str) -> None:
    """Merge all that a stream offers now, batch by batch; a batch repeated after a failure changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def in_slices(df: DataFrame, at: str, edges: list[str]) -> list[DataFrame]:
    """Rows by date, cut before each edge."""
    limits = [F.col(at) >= F.to_date(F.lit(e)) for e in edges]
    place = functools.reduce(lambda acc, c: acc + c.cast("int"), limits, F.lit(0))
    return [df.where(place == k) for k in range(len(edges) + 1)]
