"""Streams of hook events: counters, windows, dedup by a time to live, open runs.

Each operator takes a streaming (or, where stateless, a batch) DataFrame and returns one;
the caller picks sink, trigger and checkpoint location. The stateful ones need the
RocksDB state store, whose state is not held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_counts(events: DataFrame) -> DataFrame:
    """Events and their value by session: a stream in update mode."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def late_windows(events: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; a window closes when the watermark passes it."""
    timed = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


def _expire_at(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer for the key, at this time."""
    for timer in handle.listTimers():
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts_us", "id"], kind="stable")


class TtlDedup(StatefulProcessor):
    """Keeps an event unless one of its key was kept less than the time to live before; forgets a key once that can hide nothing."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = _ordered(rows)
        times, keep = found["ts_us"].to_numpy(), []
        last = self.last.get()[0] if self.last.exists() else None
        at = 0 if last is None else int(np.searchsorted(times, last + self.ttl_us))
        while at < len(times):  # from one kept event to the next, whatever lies between
            last = int(times[at])
            keep.append(at)
            at = int(np.searchsorted(times, last + self.ttl_us))
        self.last.update((int(last),))
        _expire_at(self.handle, -(-(last + self.ttl_us) // 1000))
        yield found.iloc[keep][["key", "id", "ts_us"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class OpenRuns(StatefulProcessor):
    """Numbers the runs of a session: a prompt opens one if none is open, a completed task closes it; an idle session is forgotten."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "no long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        no, is_open = self.state.get() if self.state.exists() else (0, False)
        found = _ordered(rows)
        opens, closes = (found["kind"] == "open").to_numpy(), (found["kind"] == "close").to_numpy()
        marks = pd.Series(np.where(opens, 1.0, np.where(closes, 0.0, np.nan))).ffill().fillna(float(is_open)).to_numpy() == 1  # open after each row
        before = np.concatenate([[bool(is_open)], marks[:-1]])
        numbers = no + np.cumsum(opens & ~before)
        inside = marks & ~closes
        self.state.update((int(numbers[-1]), bool(marks[-1])))
        _expire_at(self.handle, int(found["ts_us"].iloc[-1] + self.idle_us) // 1000)
        yield pd.DataFrame({"key": found["key"].to_numpy()[inside], "id": found["id"].to_numpy()[inside], "run_no": numbers[inside]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)


def ttl_dedup(events: DataFrame, ttl_us: int = 300_000_000, late: str = "10 minutes") -> DataFrame:
    """Streaming dedup of ``key, id, ts_us``; agrees with the batch operator when batches come in time order.

    Events later than the watermark are dropped; a key's state goes when the watermark passes its window.
    """
    return _timed(events, late).groupBy("key").transformWithStateInPandas(TtlDedup(ttl_us), "key string, id long, ts_us long", "Append", "EventTime")


def open_runs(events: DataFrame, idle_us: int = 86_400_000_000, late: str = "10 minutes") -> DataFrame:
    """Streaming run numbers of ``key, id, ts_us, kind``, kind being ``open``, ``close`` or anything else.

    The state of a session without events for ``idle_us`` goes, and its numbers begin anew.
    """
    return _timed(events, late).groupBy("key").transformWithStateInPandas(OpenRuns(idle_us), "key long, id long, run_no long", "Append", "EventTime")
