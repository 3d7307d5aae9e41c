"""Helpers shared by the operators: word rule, let-bindings, lineage cuts, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector

#: Separators between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows up to which a table of a few narrow columns is sent to every executor.
BROADCAST_ROWS = 500_000
#: Bytes of rows that are handed to Python at a time.
BATCH_BYTES = 4 << 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when the body is a lambda's body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_folder(spark) -> str:
    """The checkpoint folder that the session names; where none is set, one of our own, on a single machine only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def lean(spark) -> None:
    """Texts go to Python a few megabytes at a time, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and the table's path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    return stored(df)[0]


def discard(spark, *paths: str) -> None:
    """Delete stored tables that no plan still to run reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove(spark, *paths: str, wait: bool = False) -> None:
    """``discard``, and what else nothing refers to."""
    discard(spark, *paths)
    tidy(spark, wait)


def tidy(spark, wait: bool = False) -> None:
    """Drop the files of exchanges and checkpoints that nothing refers to any more; Spark deletes them once their plans are collected.

    Python lets go of plans in a thread that looks about once a second, so
    without waiting for it the files of the last job stay until the next call.
    """
    gc.collect()
    if wait:
        time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()
    if wait:
        time.sleep(0.5)


def released(run):
    """``run``, a function of batches, whose worker hands memory that it has freed back to the system when a partition ends.

    Workers live on from task to task; without it each keeps its largest state, beside those of later stages.
    """

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            vector.forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return bounded


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table, marked for broadcast if it has at most ``limit`` rows.

    Above the limit it is returned as it is: the join then shuffles, and
    adaptive execution splits the partitions of hot keys.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
