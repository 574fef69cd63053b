"""Task states on a stream: guarded transitions, late events, and tasks that fall silent.

Events (task, ord, state, ts) arrive in any order.  A task keeps its events by ``ord``
and walks its states over them in that order, so a late event counts where it belongs
and the outcome is that of ``traces.task_states`` over all events.  A task that has not
ended and hears nothing for ``silent_seconds`` of event time is reported as stale by a
timer; an event after that makes it live again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from harrow.operators.traces import TRANSITIONS
from harrow.plans.ship import ship

OUTPUT = "task string, state string, ord long, refused int, stale boolean"
#: The state store that keeps lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(events: list[tuple[int, str]]) -> tuple[str, int, int]:
    """State after events (ord, state) in that order, ord of the last that was permitted, how many were not."""
    now, at, refused = "pending", -1, 0
    for ord_, state in events:
        if state in TRANSITIONS.get(now, ()):
            now, at = state, ord_
        else:
            refused += 1
    return now, at, refused


class TaskStates(StatefulProcessor):
    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "ord long, state string", "n int")
        self.heard = handle.getValueState("heard", "at long, due long")

    def _row(self, key: Any, stale: bool) -> pd.DataFrame:
        state, at, refused = walk(sorted(k for k in self.events.keys()))
        return pd.DataFrame({"task": [key[0]], "state": [state], "ord": [at], "refused": [refused], "stale": [stale and bool(TRANSITIONS[state])]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = 0
        for frame in rows:
            for ord_, state, ts in zip(frame["ord"].tolist(), frame["state"].tolist(), frame["ts"], strict=True):
                self.events.updateValue((int(ord_), state), (1,))
                latest = max(latest, int(ts.timestamp() * 1000))
        before = self.heard.get()
        latest = max(latest, before[0] if before else 0)
        if before and before[1] != latest + self.silent_ms:
            self.handle.deleteTimer(before[1])
        out = self._row(key, False)
        if TRANSITIONS[out["state"][0]]:
            self.handle.registerTimer(latest + self.silent_ms)
        self.heard.update((latest, latest + self.silent_ms))
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._row(key, True)
        if out["stale"][0]:
            yield out

    def close(self) -> None:
        pass


def task_state_stream(events: DataFrame, silent_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(task, state, ord, refused, stale): a row whenever a task hears of an event or falls silent.

    Needs the state store ``PROVIDER``.  Repeated events (same ord and state) count
    once; events more than ``late`` behind the latest may be dropped.  Memory of a task
    grows with its own events.
    """
    spark = events.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = events.select(F.col("task").cast("string"), F.col("ord").cast("long"), F.col("state").cast("string"), "ts").filter("task IS NOT NULL AND ord IS NOT NULL AND state IS NOT NULL AND ts IS NOT NULL")
    return rows.withWatermark("ts", late).groupBy("task").transformWithStateInPandas(TaskStates(silent_seconds * 1000), OUTPUT, "Update", "EventTime")
