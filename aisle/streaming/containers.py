"""Live board of containers whose state ends.

A container's visit is the stretch of its events without a longer silence than allowed. The
board shows the newest visit; its state is dropped by an event-time timer once no event can
belong to it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aisle.operators import port

#: First and last event, when and by which event the status was set, the status; arrival and departure. Microseconds.
VISIT = "start long, last long, status_at long, status_id long, status string, arrived long, departed long"
BOARD = "container_id {}, visit_start long, status string, arrived long, departed long"
NEVER = -1


def _later(a: tuple, b: tuple) -> tuple:
    """Two parts of one visit as one."""
    status = max(a[2:5], b[2:5])
    return (min(a[0], b[0]), max(a[1], b[1]), *status, max(a[5], b[5]), max(a[6], b[6]))


def join_visits(visits: list[tuple], silence: int) -> list[tuple]:
    """Visits that are no further apart than the silence become one."""
    joined: list[tuple] = []
    for visit in sorted(visits):
        if joined and visit[0] - joined[-1][1] <= silence:
            joined[-1] = _later(joined[-1], visit)
        else:
            joined.append(visit)
    return joined


def visits_of(frame: pd.DataFrame, silence: int) -> list[tuple]:
    """Visits of one container's events."""
    frame = frame.sort_values(["at", "event_id"])
    at = frame["at"].to_numpy(np.int64)
    found = []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > silence) + 1):
        some = frame.iloc[part]
        told = some[some["status"].notna()]
        status = (int(told["at"].iloc[-1]), int(told["event_id"].iloc[-1]), told["status"].iloc[-1]) if len(told) else (NEVER, NEVER, "")
        ends = [int(some["at"].where(some[c]).max()) if some[c].any() else NEVER for c in ("arrival", "departure")]
        found.append((int(at[part[0]]), int(at[part[-1]]), *status, *ends))
    return found


class Board(StatefulProcessor):
    """State of a container: its newest visit."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", VISIT)

    def _wake(self, visit: tuple) -> None:
        self.handle.registerTimer((visit[1] + self.silence) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        visits = [tuple(self.visit.get())] if self.visit.exists() else []
        for frame in rows:
            # Frames fold one by one, so a container with very many events needs no more room than its visits.
            visits = join_visits(visits + visits_of(frame, self.silence), self.silence)
        newest = visits[-1]
        self.visit.update(newest)
        self._wake(newest)
        yield pd.DataFrame(
            {"container_id": [key[0]], "visit_start": [newest[0]], "status": [newest[4]], "arrived": [newest[5]], "departed": [newest[6]]}
        )

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.visit.exists():
            visit = tuple(self.visit.get())
            if visit[1] + self.silence < timerValues.getCurrentWatermarkInMs() * 1000:
                self.visit.clear()
            else:
                self._wake(visit)
        yield from ()

    def close(self) -> None:
        pass


def container_board(events: DataFrame, silence_days: float = 30, lateness: str = "10 minutes") -> DataFrame:
    """Status of the newest visit of every container with new events (update mode).

    Rows (container_id, visit_start, status, arrival_time, departure_time). Events of one moment are
    taken by event_id. A container silent for longer than ``silence_days`` has left and begins a new visit with its next
    event, however the events fall into micro-batches; what is kept of it goes when the watermark has passed that time.
    Rows without a container or time are ignored. Needs the RocksDB state store, see ``feeds.run_available``.
    """
    status = port.event_status(F.col("event_type"))
    rows = events.select(
        "container_id", F.col("event_time").cast("timestamp").alias("event_time"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"),
        status.alias("status"), F.col("event_type").eqNullSafe("vessel_arrival").alias("arrival"), status.eqNullSafe("departed").alias("departure"),
    ).where("container_id IS NOT NULL AND event_time IS NOT NULL")
    rows = rows.withWatermark("event_time", lateness).withColumn("at", F.unix_micros("event_time"))
    kind = rows.schema["container_id"].dataType.simpleString()
    found = rows.groupBy("container_id").transformWithStateInPandas(
        statefulProcessor=Board(int(silence_days * 86_400_000_000)), outputStructType=BOARD.format(kind), outputMode="Update", timeMode="EventTime"
    )
    time = lambda c: F.when(F.col(c) != NEVER, F.timestamp_micros(c))
    return found.select(
        "container_id", F.timestamp_micros("visit_start").alias("visit_start"), F.coalesce(F.nullif("status", F.lit("")), F.lit("en_route")).alias("status"),
        time("arrived").alias("arrival_time"), time("departed").alias("departure_time"),
    )
