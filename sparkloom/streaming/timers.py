"""Debounce by state and timers: of calls that follow each other within a quiet time only the last is acted on, when it has passed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: The state store that timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Quiet(StatefulProcessor):
    """State of a key: the last call, its second, and the calls since the last quiet time; one timer, where that would end."""

    def __init__(self, key: str, seconds: int):
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "value long, at long, n long")

    def _rows(self, key: tuple, calls: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *c) for c in calls], columns=[self.key, "value", "at", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending, timer = self.pending.get(), None
        if pending is not None:
            timer = (pending[1] + self.seconds) * 1000
        done = []
        calls = [c for part in rows for c in zip(part["at"].tolist(), part["value"].tolist(), strict=True)]
        for at, value in sorted(calls):
            if pending is not None and at - pending[1] >= self.seconds:  # the quiet time passed inside this batch
                done.append(pending)
                pending = None
            pending = (value, at, 1 if pending is None else pending[2] + 1)
        self.pending.update(pending)
        ends = (pending[1] + self.seconds) * 1000
        if timer is not None and timer != ends:
            self.handle.deleteTimer(timer)
        if timer != ends:
            self.handle.registerTimer(ends)
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.pending.get()
        if last is not None:
            self.pending.clear()
            yield self._rows(key, [tuple(last)])

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, key: str, at: str, value: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, value, at, n): the last call of each run without a pause of ``seconds``, its second, and the calls of the run (append mode).

    The session must use the state store of PROVIDER.  A call is handed on when the watermark passes its quiet time; calls that come
    later than the watermark allows are let go by it."""
    kind = stream.schema[key].dataType.simpleString()
    calls = stream.withWatermark(at, late).select(key, at, F.col(value).cast("long").alias("value"), F.expr(f"unix_micros(cast({at} as timestamp)) div 1000000").alias("at"))
    return calls.groupBy(key).transformWithStateInPandas(Quiet(key, seconds), f"{key} {kind}, value long, at long, n long", "Append", "EventTime")
