from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from helpers import frame, rows

from pyspark.sql import functions as F
from tradewind.operators import timelines
from tradewind.streaming import timers

GAP = timedelta(hours=6)
KIND = "user_id bigint, event_type string, occurred_at timestamp"


def test_fold_joins_what_is_close_in_any_order():
    r = random.Random(4)
    for _ in range(200):
        at = [r.randrange(300) for _ in range(r.randrange(1, 30))]
        want, last = [], None
        for t in sorted(at):
            if last is None or t - last > 7:
                want.append([t, t, 0])
            want[-1][1:] = [t, want[-1][2] + 1]
            last = t
        held = np.empty((0, 5), np.int64)
        for k in range(0, len(at), 4):
            part = np.array([(t, t, 1, 0, 1) for t in at[k : k + 4]], np.int64)
            held = timers.fold(np.concatenate([held, part]), 7)
        assert held[:, :3].tolist() == want and held[:, 4].tolist() == held[:, 2].tolist()


def test_equal_to_the_batch_after_restarts(spark, tmp_path):
    """Three pulls, each by a fresh start from the checkpoint; rows of one pull come in any order."""
    r, start = random.Random(1), datetime(2024, 1, 1)
    kinds = ["view", "add_to_cart", "purchase", None]
    data = [(r.choice([1, 2, 3, None]), r.choice(kinds), str(start + timedelta(minutes=r.randrange(14 * 1440)))) for _ in range(300)]
    data += [(7, "view", str(start + timedelta(hours=6 * k))) for k in range(5)]  # pauses of exactly the gap do not part
    sink, checkpoint, src = (str(tmp_path / n) for n in ("sink", "progress", "in"))
    for low, high in ((0, 5), (5, 9), (9, 15)):
        days = [e for e in data if start + timedelta(days=low) <= datetime.fromisoformat(e[2]) < start + timedelta(days=high)]
        r.shuffle(days)
        pull = frame(spark, KIND, days)
        pull.repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema(pull.schema).parquet(src)
        got = timers.run_with_rocksdb(timers.closed_sessions(stream, GAP, "2 hours"), sink, checkpoint)
    every = frame(spark, KIND, data)
    mark = every.agg(F.max("occurred_at")).first()[0] - timedelta(hours=2)
    want = timelines.sessionize(every, GAP).filter(F.col("session_end") + F.expr("INTERVAL 6 HOURS") <= F.lit(mark))
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 50


def test_late_events_do_not_reopen_and_nothing_is_closed_early(spark, tmp_path):
    sink, checkpoint, src = (str(tmp_path / n) for n in ("sink", "progress", "in"))

    def pull(*data):
        batch = frame(spark, KIND, list(data))
        batch.write.mode("append").parquet(src)
        stream = spark.readStream.schema(batch.schema).parquet(src)
        got = timers.run_with_rocksdb(timers.closed_sessions(stream, GAP, "2 hours"), sink, checkpoint)
        return [(r.user_id, r.n_events, r.status) for r in got.orderBy("session_start").collect()]

    assert pull((1, "add_to_cart", "2024-01-01 00:00:00"), (2, "view", "2024-01-01 07:59:59")) == []
    assert pull((2, "view", "2024-01-01 08:00:00")) == [(1, 1, "abandoned")]
    assert pull((1, "purchase", "2024-01-01 01:00:00"), (2, "view", "2024-01-03 00:00:00")) == [(1, 1, "abandoned"), (2, 2, "browsing")]


class _Handle:
    """Stands in for Spark's handle: one user's state and timers."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class _Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_a_user_has_one_timer_however_many_sessions_are_open():
    hour, n = 3_600_000_000, 400
    handle, job = _Handle(), timers.OpenSessions("user_id", GAP)
    job.init(handle)
    for k in (n // 2, 0):  # the earlier half comes last, so the timer moves forward in time
        at = [24 * hour * d for d in range(k, k + n // 2)]
        list(job.handleInputRows((1,), iter([pd.DataFrame({"at": at, "adds": 0, "buys": 0})]), _Clock(0)))
    assert handle.timers == {6 * hour // 1000} and handle.calls == 2
    fired = _Clock((24 * hour * (n - 1) - 1) // 1000)  # all days but the last are over
    handle.timers.clear()
    closed = pd.concat(list(job.handleExpiredTimer((1,), fired, _Clock(6 * hour // 1000))))
    assert len(closed) == n - 1 and len(handle.rows) == 1
    assert handle.timers == {(24 * hour * (n - 1) + 6 * hour) // 1000}
