"""Silences while they last: keyed state with event-time timers.

A ping that ends a silence isn't waited for: when the watermark has passed a vessel's last ping by the limit, the silence is told
as open; when the next ping comes, it is told again with its end. Vessels not heard for long are forgotten by a timer, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SILENCES = "mmsi long, t_start long, t_end long"


class Silences(StatefulProcessor):
    """State of a vessel: its last ping's second, whether its silence was told as open, and late pings so far."""

    def __init__(self, longer_s: int, forget_s: int) -> None:
        self.longer_s, self.forget_s = longer_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sec long, told boolean, late long")

    def _due(self, sec: int, told: bool) -> int:
        """When the vessel's one timer runs out."""
        return (sec + (self.forget_s if told else self.longer_s)) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a message to the JVM, so there are as few as can be
        every = np.sort(np.concatenate([b["sec"].to_numpy(np.int64) for b in rows]))
        held = self.last.get()
        last, told, late = held if held is not None else (None, False, 0)
        new = every if last is None else every[every > last]
        # equal to the last one is the same ping again, older ones are late
        older = 0 if last is None else int((every < last).sum())
        if len(new):
            if last is not None:
                self.handle.deleteTimer(self._due(last, told))
            self.handle.registerTimer(self._due(int(new[-1]), False))
            self.last.update((int(new[-1]), False, late + older))
        elif older:
            self.last.update((last, told, late + older))
        times = new if last is None else np.concatenate([[last], new])
        at = np.flatnonzero(np.diff(times) > self.longer_s)
        if len(at):
            yield pd.DataFrame({"mmsi": np.int64(key[0]), "t_start": times[at], "t_end": pd.array(times[at + 1], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told, late = self.last.get()
        if told:
            self.last.clear()
            return
        self.last.update((last, True, late))
        # the timer that ran out is gone by itself
        self.handle.registerTimer(self._due(last, True))
        yield pd.DataFrame({"mmsi": [np.int64(key[0])], "t_start": [last], "t_end": pd.array([None], "Int64")})

    def close(self) -> None:
        pass


def silences(stream: DataFrame, at: str, late: str, longer_s: int, forget_s: int) -> DataFrame:
    """(mmsi, t_start, t_end) of a stream of (mmsi, sec, at): t_end is null where a silence is told while it lasts.

    at is sec as a timestamp, late the watermark's delay, forget_s (more than longer_s) the seconds after which a silent vessel's
    state goes; its next ping then begins anew. Pings older than a vessel's last one open no silence and are counted in its
    state. The session must keep state in RocksDB, which `with_timers` sets.
    """
    if forget_s <= longer_s:
        raise ValueError("forget_s must be more than longer_s")
    marked = stream.withWatermark(at, late)
    return marked.groupBy("mmsi").transformWithStateInPandas(statefulProcessor=Silences(longer_s, forget_s), outputStructType=SILENCES, outputMode="Append", timeMode="EventTime")


def with_timers(spark: SparkSession) -> SparkSession:
    """The session, with state in RocksDB, as timers need it. Streams that were begun with another store can't go on with it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return spark


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(mmsi, sec, told, late): the vessels that a stopped stream has in mind, read from its checkpoint."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return rows.select("key.mmsi", "value.sec", "value.told", "value.late")
