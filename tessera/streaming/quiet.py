"""Debounced change events with state of our own: runs of events that end in quiet, or are told early when they last too long.

Spark's session windows (``watch.debounced``) tell a run once the watermark has passed its end. A path that is written all the time
would never be told. Here a keyed processor holds the open runs of a path; a timer of event time tells each once nothing came for
``gap``, or, with ``most``, once it has been open that long, as it is by then, and what follows is a new run.

A task first joins the events of a batch that lie in one bin of time no wider than the gap, which belong to one run anyway, so a
path that a third of all events are for reaches its task as a few rows a batch. Open runs of a path are bounded by the watermark's
delay over the gap. State is in RocksDB below the query's checkpoint, from which a query that was stopped or lost goes on.

Defined results: events without a key or a time are left out; events behind the watermark are too late and are left out, but where
one of the same bin and batch isn't;
events of equal time count one by one; a run's end is its last event; runs come in no order. Without ``most`` the runs are those of
``watch.debounced``, but for its end, which adds the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors with timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, events), sorted, of which those no farther apart than ``gap`` are one, as session windows have it."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(runs):
        if out and start - out[-1][1] <= gap:
            last = out[-1]
            out[-1] = (last[0], max(last[1], end), last[2] + n)
        else:
            out.append((start, end, n))
    return out


def combined(events: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """(key, time, start, end, n): the events of a task's batch by key and bin of time."""

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.groupby([batch["key"], batch["us"] // gap]).agg(key=("key", "first"), time=("time", "max"), start=("us", "min"), end=("us", "max"), n=("us", "size"))

    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("time"), F.unix_micros(ts).alias("us"))
    return rows.mapInPandas(of_task, "key string, time timestamp, start long, end long, n long")


class Runs(StatefulProcessor):
    """The open runs of a key, and one timer for the first that is over: what it tells then sets the next."""

    def __init__(self, gap: int, most: int | None):
        self.gap, self.most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("runs", "runs binary")  # one value a key: each value costs a message

    def _held(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return [] if held is None else list(map(tuple, np.frombuffer(held[0], np.int64).reshape(-1, 3).tolist()))

    def _due(self, run: tuple[int, int, int]) -> int:
        """The event time, in ms, at which a run is told."""
        due = run[1] + self.gap
        due = due if self.most is None else min(due, run[0] + self.most)
        return -(-due // 1000)

    def _settle(self, key: tuple, runs: list[tuple[int, int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        told, left = [], []
        for run in runs:
            (told if self._due(run) <= watermark else left).append(run)
        self.open.update((np.array(left, np.int64).tobytes(),)) if left else self.open.clear()
        due = min((self._due(run) for run in left), default=None)
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)
        if told:
            start, end, n = zip(*told, strict=True)
            stamps = lambda us: pd.to_datetime(pd.Series(us), unit="us", utc=True)
            yield pd.DataFrame({"key": key[0], "start": stamps(start), "end": stamps(end), "n": n})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        runs = self._held()
        for batch in rows:
            runs += zip(batch["start"].tolist(), batch["end"].tolist(), batch["n"].tolist(), strict=True)
        yield from self._settle(key, merged(runs, self.gap), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def quiet(events: DataFrame, key: str, ts: str = "ts", gap_s: float = 2.0, late: str = "10 minutes", most_s: float | None = None) -> DataFrame:
    """(key, start, end, n) of a stream's runs of events, told once they are over. ts: a timestamp with the session's zone."""
    gap = int(gap_s * 1e6)
    rows = combined(events, key, ts, gap).withWatermark("time", late)
    processor = Runs(gap, None if most_s is None else int(most_s * 1e6))
    return rows.groupBy("key").transformWithStateInPandas(processor, "key string, start timestamp, end timestamp, n long", "append", "eventTime")
