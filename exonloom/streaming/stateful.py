"""Streams with state: bursts of events of a key, closed by the watermark, and session windows.

A burst is the streaming form of a cluster with slack: events of one key of which each lies at most ``slack`` behind the
one before.  It is final, and given out once, when the watermark has passed its last event by ``slack``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bursts_of(times: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last time and number of events of each burst of the sorted ``times``."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(times) > slack]))
    last = np.concatenate([first[1:], [len(times)]]) - 1
    return times[first], times[last], last - first + 1


class Bursts(StatefulProcessor):
    """Keeps the bursts of a key that are not closed yet, as one value: the timer that is set, then (first, last, events).

    Events that lie between the first and the last of a burst join it, so the events themselves are not needed.  One
    timer waits for the first burst that can close, so a batch costs a key one read and one write of its state.
    """

    def __init__(self, slack_ms: int, kind: str):
        self.slack, self.kind = slack_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "open binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, n = np.unique(np.concatenate([frame["at"].to_numpy(np.int64) for frame in rows]), return_counts=True)
        due, held = self._read()
        joined = self._join(np.concatenate([held, np.stack([times, times, n], axis=1)]))
        yield from self._close(key, due, joined, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, held = self._read()
        if len(held):
            passed = due <= expiredTimerInfo.getExpiryTimeInMs()
            yield from self._close(key, -1 if passed else due, held, timerValues.getCurrentWatermarkInMs())

    def _read(self) -> tuple[int, np.ndarray]:
        kept = self.held.get() if self.held.exists() else None
        if kept is None:
            return -1, np.zeros((0, 3), np.int64)
        kept = np.frombuffer(bytes(kept[0]), np.int64)
        return int(kept[0]), kept[1:].reshape(-1, 3)

    def _join(self, parts: np.ndarray) -> np.ndarray:
        """Bursts of the parts ``(first, last, events)``: a part joins what ends at most ``slack`` before it."""
        parts = parts[np.argsort(parts[:, 0], kind="stable")]
        reach = np.maximum.accumulate(parts[:, 1])
        heads = np.flatnonzero(np.concatenate([[True], parts[1:, 0] - reach[:-1] > self.slack]))
        return np.stack(
            [parts[heads, 0], np.maximum.reduceat(parts[:, 1], heads), np.add.reduceat(parts[:, 2], heads)], axis=1
        )

    def _close(self, key, due: int, held: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """Give out what the watermark has passed; the timer waits for the end of the first burst still open."""
        done = held[:, 1] + self.slack <= watermark
        still = held[~done]
        if len(still):
            end = int(still[0, 1]) + self.slack  # bursts of a key end in the order in which they begin
            if due < 0 or due > end:
                self.handle.registerTimer(end)
                due = end
            self.held.update((np.concatenate([[due], still.ravel()]).astype(np.int64).tobytes(),))
        else:
            self.held.clear()
        if done.any():
            first, last, n = held[done].T
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(n)), "first_ms": first, "last_ms": last, "n": n})

    def close(self) -> None:
        pass


def bursts(stream: DataFrame, key: str, time: str, slack: str, delay: str) -> DataFrame:
    """``(key, first_ms, last_ms, n)`` of every closed burst of a stream, in append mode.

    ``slack`` and ``delay`` are SQL intervals; events more than ``delay`` behind the latest are late and dropped.  Rows with
    a null key or time are left out.  Needs the state store that ``with_state_store`` sets.
    """
    spark = stream.sparkSession
    slack_ms = int(spark.sql(f"select unix_millis(timestamp_millis(0) + interval {slack})").first()[0])
    kind = dict(stream.dtypes)[key]
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(F.col(key).alias("key"), F.unix_millis(time).alias("at"), F.col(time).alias("event_time"))
    return rows.groupBy("key").transformWithStateInPandas(
        Bursts(slack_ms, kind), f"key {kind}, first_ms bigint, last_ms bigint, n bigint", "Append", "EventTime"
    )


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """``(key, first, until, n)`` of every closed session window, by Spark's own operator."""
    window = F.session_window(F.col(time), gap)
    counted = stream.withWatermark(time, delay).groupBy(window.alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col(key).alias("key"), F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


@contextmanager
def with_state_store(spark: SparkSession):
    """State in RocksDB while streams are started; the setting is put back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drain(made: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over what is available, append to ``out`` and stop; a restart goes on from ``checkpoint``."""
    with with_state_store(made.sparkSession):
        query = (
            made.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query
