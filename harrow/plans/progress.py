"""Feeds of long runs: start, progress, then exactly one of done, error or cancelled.

Tasks add to an accumulator what they have finished; a thread of the driver reads it and
tells the feed, so the feed costs no job.  Streams tell theirs through Spark's listener.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Accumulator
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Seconds between two looks at the accumulator.
LOOK_S = 0.2


@dataclass(frozen=True)
class Event:
    kind: str  # start, progress, done, error or cancelled
    done: int
    total: int | None = None
    message: str | None = None


Feed = Callable[[Event], None]


class Progress:
    """Runs an action and feeds what its tasks count.

    An accumulator counts a task again that is run again, so progress never passes the
    total, and the count of ``done`` is what the action returns.
    """

    def __init__(self, spark: SparkSession, feed: Feed, total: int | None = None):
        self.count: Accumulator = spark.sparkContext.accumulator(0)
        self.feed, self.total = feed, total
        self.cancelled, self.ended = threading.Event(), threading.Event()
        self._lock = threading.Lock()

    def cancel(self) -> None:
        """From now on the feed hears ``cancelled`` and nothing else."""
        with self._lock:
            if not self.ended.is_set():
                self.cancelled.set()
                self.ended.set()
                self.feed(Event("cancelled", self._now(), self.total))

    def _now(self) -> int:
        return min(self.count.value, self.total) if self.total is not None else self.count.value

    def _tell(self, event: Event, last: bool = False) -> None:
        with self._lock:
            if not self.ended.is_set():
                if last:
                    self.ended.set()
                self.feed(event)

    def _watch(self) -> None:
        told = 0
        while not self.ended.wait(LOOK_S):
            now = self._now()
            if now != told:
                told = now
                self._tell(Event("progress", now, self.total))

    def run(self, action: Callable[[Accumulator], int]) -> int:
        """``action`` gets the accumulator and returns how many there were in the end."""
        self._tell(Event("start", 0, self.total))
        watcher = threading.Thread(target=self._watch, daemon=True)
        watcher.start()
        try:
            n = action(self.count)
        except BaseException as e:
            self._tell(Event("error", self._now(), self.total, f"{type(e).__name__}: {e}"), last=True)
            raise
        else:
            self._tell(Event("done", n, self.total), last=True)
            return n
        finally:
            watcher.join()


class StreamFeed(StreamingQueryListener):
    """Feeds the rows of streaming queries, by the name of the query.

        listener = StreamFeed({"upserts": events.append})
        spark.streams.addListener(listener)
    """

    def __init__(self, feeds: dict[str, Feed]):
        self.feeds, self.rows, self.names = feeds, {}, {}

    def _tell(self, name: str | None, event: Event) -> None:
        if name in self.feeds:
            self.feeds[name](event)

    def onQueryStarted(self, event) -> None:  # noqa: N802  the listener's names are Spark's
        run = str(event.runId)
        self.names[run], self.rows[run] = event.name, 0
        self._tell(event.name, Event("start", 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        if event.progress.numInputRows:
            self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows
            self._tell(event.progress.name, Event("progress", self.rows[run]))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        failed = event.exception
        self._tell(self.names.pop(run, None), Event("error" if failed else "done", self.rows.pop(run, 0), message=failed))


def wait_for(condition: Callable[[], bool], seconds: float = 10.0) -> bool:
    """Listeners hear of things a little later than they happen."""
    until = time.monotonic() + seconds
    while not condition() and time.monotonic() < until:
        time.sleep(0.05)
    return condition()
