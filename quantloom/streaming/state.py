"""Recursive indicators of a stream of prices: exponential means and streaks that live in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import place_of

KEY, TIME = "ts_code", "trade_date"
#: Spans of the two means of a MACD and of its signal.
SPANS = (12, 26, 9)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = f"{KEY} string, {TIME} date, close double, macd double, macd_signal double, up_days int, late boolean"


def step(state: tuple | None, close: float, change: float, spans: tuple[int, int, int] = SPANS) -> tuple[float, float, float, int]:
    """(fast mean, slow mean, signal, streak of rises) after one more bar."""
    up = 1 if change > 0 else 0
    if state is None:
        return close, close, 0.0, up
    fast, slow, signal, streak = state
    a, b, c = (2.0 / (n + 1) for n in spans)
    fast, slow = (1 - a) * fast + a * close, (1 - b) * slow + b * close
    return fast, slow, (1 - c) * signal + c * (fast - slow), streak + 1 if up else 0


class Indicators(StatefulProcessor):
    """One value per instrument: the means, the streak and the last date.

    Rows of a batch are taken by date, several of one date one after the
    other.  A row at or before the last date of the batches before comes too late: it changes nothing and
    leaves marked, for a side table.  An instrument that is silent for
    ``idle_ms`` of processing time is forgotten, so that state is bounded by
    the live instruments.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("indicators", "fast double, slow double, signal double, streak int, day date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values([TIME, "close", "pct_chg"], kind="stable")
        held = self.value.get() if self.value.exists() else None
        state, day = (tuple(held[:4]), held[4]) if held is not None else (None, None)
        closed = day
        out = []
        for at, close, change in zip(bars[TIME], bars["close"], bars["pct_chg"], strict=True):
            if closed is not None and at <= closed:
                out.append((at, close, np.nan, np.nan, -1, True))
                continue
            state, day = step(state, close, change), at
            out.append((at, close, state[0] - state[1], state[2], state[3], False))
        if state is not None:
            self.value.update((*state, day))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        found = pd.DataFrame(out, columns=[TIME, "close", "macd", "macd_signal", "up_days", "late"])
        found.insert(0, KEY, key[0])
        yield found.astype({"up_days": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def indicators(bars: DataFrame, idle_ms: int = 90 * 86_400_000) -> DataFrame:
    """A stream of bars (ts_code, trade_date, close, pct_chg) with macd, macd_signal, up_days and ``late``.

    Rows without key, date, close or change are left out.  The session needs the RocksDB state store (see ``feed``).
    """
    whole = bars.select(KEY, TIME, "close", "pct_chg").dropna()
    return whole.groupBy(KEY).transformWithStateInPandas(Indicators(idle_ms), OUTPUT, "Append", "ProcessingTime")


def run(bars: DataFrame, place: str) -> None:
    """Take all that a stream offers now into ``place``: rows into ``main``, late ones into ``late``, each batch under its own number.

    A batch that is repeated after a failure overwrites what it wrote before.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(~F.col("late")).drop("late").write.mode("overwrite").parquet(f"{place}/main/batch={number}")
        batch.where("late").select(KEY, TIME, "close").write.mode("overwrite").parquet(f"{place}/late/batch={number}")
        batch.unpersist()

    started = indicators(bars).writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    started.start().awaitTermination()


def feed(spark: SparkSession, slices: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, late rows) of slices of bars that arrive one after the other, the stream being stopped and started again in between."""
    place = place_of(spark)
    # Keyed processors need RocksDB; a batch without data, which timers of processing time ask for again and again, never
    # lets a run end, so timers fire with the next data.
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        for slice_ in slices:
            slice_.select(KEY, TIME, "close", "pct_chg").write.mode("append").parquet(f"{place}/inbox")
            run(spark.readStream.schema(f"{KEY} string, {TIME} date, close double, pct_chg double").parquet(f"{place}/inbox"), place)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    main = f"{KEY} string, {TIME} date, close double, macd double, macd_signal double, up_days int, batch int"
    return spark.read.schema(main).parquet(f"{place}/main"), spark.read.schema(f"{KEY} string, {TIME} date, close double, batch int").parquet(f"{place}/late")
