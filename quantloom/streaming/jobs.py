"""Structured Streaming twins of the incremental steps.  Each takes a streaming (or batch) DataFrame and returns one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream, with the table's own schema."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether the table is one file: its rows then carry its own path as their input file."""
    first = spark.read.parquet(path).select(F.input_file_name().alias("f")).first()
    return first is not None and first["f"].rstrip("/").endswith(path.rpartition("/")[2])


def place_of(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder that the session names; where none is set, in one of our own, on a single machine only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new folder of ``place_of``, read again: what several passes read is computed once."""
    path = f"{place_of(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that a finite stream emits row by row, as a table in the session's shared folder; offsets and state are kept beside it."""
    spark = stream.sparkSession
    place = place_of(spark)
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


#: How far after the last event the closing row lies.
CLOSING = "interval 10 years"


def closed(events: DataFrame, windows: Callable[[DataFrame], DataFrame], last: datetime, at: str = "ts") -> DataFrame:
    """What ``windows`` emits of a finite stream when all of its windows have closed.

    Windows are emitted once the watermark has passed them, and their state is
    dropped then.  When the stream is drained, one row long after ``last``,
    whose other columns are null, moves the watermark on; its own window stays open, and nothing of
    it is emitted.  The stream goes on from its checkpoint in between, as after a restart.
    """
    spark, place = events.sparkSession, place_of(events.sparkSession)
    schema = events.schema
    none = spark.createDataFrame([], schema)
    none.write.parquet(f"{place}/closing")
    both = events.unionByName(spark.readStream.schema(schema).parquet(f"{place}/closing"))
    out = windows(both)

    def run() -> None:
        out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    ahead = F.lit(last).cast("timestamp_ntz") + F.expr(CLOSING)
    spark.range(1).select(*[(ahead if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(f"{place}/closing")
    run()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def timed(ticks: DataFrame, at: str = "ts") -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return ticks.withColumn(at, F.col(at).cast("timestamp"))


def daily_rollup(ticks: DataFrame) -> DataFrame:
    """Tumbling days per event type: count, sum of cents, largest value; a day is emitted, and its late rows dropped, an hour after its end."""
    cents = F.floor(F.col("value") * F.lit(1e2) + F.lit(0.5)).cast("long")
    windows = timed(ticks).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.max("value").alias("top")).select(F.to_date("window.start").alias("day"), "event_type", "n", "cents", "top")


def sliding_mean(ticks: DataFrame) -> DataFrame:
    """Seven-day windows that start every day."""
    cents = F.floor(F.col("value") * F.lit(1e2) + F.lit(0.5)).cast("long")
    windows = timed(ticks).withWatermark("ts", "1 hour").groupBy(F.window("ts", "7 days", "1 day"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.avg(cents).alias("mean_cents")).select(F.to_date("window.start").alias("day"), "event_type", "n", "mean_cents")


def sessions(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    return timed(ticks).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n")


def first_of_content(news: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """One row per key within the horizon; a bounded form of the global dedupe."""
    return timed(news, at).withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])
