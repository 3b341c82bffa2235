"""Sessions closed by event-time timers: state that a stream keeps per user and gives up when its time has come.

A user's open sessions are the state. Events open a session, lengthen it or join two of them, in whatever order they come within
the allowed delay. A session is over at its end plus the gap; when the watermark passes that, no event that could still belong to
the session will be taken, so it is emitted once and forgotten. A user has one timer, for the session that is over first; when it
fires, all sessions behind the watermark leave in one call, however many a long pull has put there. State therefore holds only
users that were active within the gap, kept in RocksDB on the executors and saved with the checkpoint.

All events of a user within a batch reach one call as columns and are folded by array operations, so a busy user costs
memory for one Arrow batch at a time, not for all its events.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OPEN = "first long, last long, n long, adds long, buys long"


def fold(sessions: np.ndarray, gap: int) -> np.ndarray:
    """Rows (first, last, n, adds, buys) put together where the pause between them is no longer than `gap`."""
    if not len(sessions):
        return sessions
    rows = sessions[np.argsort(sessions[:, 0], kind="stable")]
    reach = np.maximum.accumulate(rows[:, 1])
    starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] - reach[:-1] > gap]))
    ends = np.maximum.reduceat(rows[:, 1], starts)
    return np.column_stack([rows[starts, 0], ends, *(np.add.reduceat(rows[:, c], starts) for c in (2, 3, 4))])


class OpenSessions(StatefulProcessor):
    def __init__(self, user: str, gap: timedelta):
        self.user, self.gap = user, int(gap.total_seconds()) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _held(self) -> np.ndarray:
        return np.array([tuple(r) for r in self.open.get()], np.int64).reshape(-1, 5)

    def _keep(self, sessions: np.ndarray) -> None:
        if len(sessions):
            self.open.put([tuple(map(int, r)) for r in sessions])
        else:
            self.open.clear()

    def _due(self, sessions: np.ndarray) -> np.ndarray:
        """When each session closes, in whole milliseconds."""
        return -(-(sessions[:, 1] + self.gap) // 1000)

    def _first_due(self, sessions: np.ndarray) -> int | None:
        return int(self._due(sessions).min()) if len(sessions) else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = before = self._held()
        for batch in rows:
            at = batch["at"].to_numpy(np.int64)
            new = np.column_stack([at, at, np.ones(len(at), np.int64), batch["adds"], batch["buys"]]).astype(np.int64)
            held = fold(np.concatenate([held, new]), self.gap)
        self._keep(held)
        due, was = self._first_due(held), self._first_due(before)
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        # The timer fires when the watermark has reached it, so the watermark is never behind it.
        over = self._due(held) <= timerValues.getCurrentWatermarkInMs()
        still, closed = held[~over], held[over]
        self._keep(still)
        if len(still):
            self.handle.registerTimer(self._first_due(still))
        out = pd.DataFrame(closed, columns=["first", "last", "n", "adds", "buys"])
        out.insert(0, self.user, key[0])
        yield out

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, gap: timedelta, delay: str, user: str = "user_id") -> DataFrame:
    """Sessions per user as the watermark closes them: the streaming twin of `sessionize`.

    Users that are null are one user, as in a grouping.
    """
    slim = events.withWatermark("occurred_at", delay).select(
        user,
        "occurred_at",
        F.unix_micros("occurred_at").alias("at"),
        (F.col("event_type") == "add_to_cart").cast("long").alias("adds"),
        (F.col("event_type") == "purchase").cast("long").alias("buys"),
    ).fillna(0, ["adds", "buys"])
    kind = events.schema[user].dataType.simpleString()
    closed = slim.groupBy(user).transformWithStateInPandas(
        statefulProcessor=OpenSessions(user, gap),
        outputStructType=f"{user} {kind}, {OPEN}",
        outputMode="append",
        timeMode="eventTime",
    )
    status = F.when(F.col("buys") > 0, "converted").when(F.col("adds") > 0, "abandoned").otherwise("browsing")
    return closed.select(
        user,
        F.timestamp_micros("first").alias("session_start"),
        F.timestamp_micros("last").alias("session_end"),
        F.col("n").alias("n_events"),
        status.alias("status"),
    )


def run_with_rocksdb(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process what has arrived with state in RocksDB, then hand back everything that was closed so far."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(sink)
