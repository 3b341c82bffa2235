from __future__ import annotations

from datetime import date

from helpers import MONEY, frame, rows

from pyspark.sql import functions as F
from tradewind.operators import timelines
from tradewind.streaming import jobs

EVENTS = "id bigint, session_id string, customer_id bigint, product_id bigint, event_type string, occurred_at timestamp"


def events(spark, data):
    return frame(spark, EVENTS, data)


def drop(df, folder, n):
    """One more file for the stream, later than the ones before it."""
    df.coalesce(1).write.mode("append").parquet(str(folder))
    assert n >= 0


def run(df, name, mode="append", checkpoint=None):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if checkpoint
        else df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return q


def test_ingest_splits_and_repeats(spark, tmp_path):
    src = tmp_path / "in"
    drop(events(spark, [
        (1, "s", 1, 7, "view", "2024-01-01"), (2, "s", 1, 7, None, "2024-01-01"), (3, "s", 1, 7, "purchase", "2024-01-01"),
        (4, "x" * 64, 1, 7, "wishlist", "2024-01-01"), (5, "x" * 65, 1, 7, "view", "2024-01-01"),
        (6, "s", 1, None, "view", "2024-01-01"), (7, None, 1, 7, "view", "2024-01-01"),
    ]), src, 0)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for checkpoint in ("c1", "c2"):  # the second run replays batch 0 from scratch
        q = jobs.ingest_events(jobs.read_stream(spark, "product_events", str(src)), good, bad, str(tmp_path / checkpoint)).start()
        q.awaitTermination(120)
    assert rows(spark.read.parquet(good).select("id", "event_type"), "id") == [(1, "view"), (2, "view"), (4, "wishlist")]
    assert rows(spark.read.parquet(bad).select("id", "reason"), "id") == [
        (3, "unknown event_type"), (5, "session_id too long"), (6, "no product_id"), (7, "no session_id")]


def late_batches(spark, src):
    drop(events(spark, [(1, "s", 1, 7, "view", "2024-01-01 10:00:00"), (2, "s", 1, 7, "view", "2024-01-01 12:30:00")]), src, 0)
    drop(events(spark, [(2, "s", 1, 7, "view", "2024-01-01 12:30:00"),   # pulled again
                        (3, "s", 1, 7, "view", "2024-01-01 11:30:00"),   # one hour late
                        (4, "s", 1, 7, "view", "2024-01-01 16:00:00")]), src, 1)
    drop(events(spark, [(7, "s", 1, 7, "view", "2024-01-01 16:30:00")]), src, 2)
    drop(events(spark, [(5, "s", 1, 7, "view", "2024-01-01 11:45:00"),   # past the watermark
                        (6, "s", 1, 7, "view", "2024-01-02 12:00:00")]), src, 3)


def test_dedupe_by_id(spark, tmp_path):
    src = tmp_path / "in"
    late_batches(spark, src)
    stream = jobs.read_stream(spark, "product_events", str(src), per_trigger=1)
    run(jobs.dedupe_stream(stream).select("id"), "dedupe")
    got = [r.id for r in spark.table("dedupe").collect()]
    assert len(got) == len(set(got)) and {1, 2, 3, 4, 6, 7} <= set(got)


def test_counts_lose_late_rows_and_the_batch_repairs(spark, tmp_path):
    src = tmp_path / "in"
    late_batches(spark, src)
    stream = jobs.dedupe_stream(jobs.read_stream(spark, "product_events", str(src), per_trigger=1))
    run(jobs.event_counts(stream, "1 day", delay=None), "counts")
    streamed = spark.table("counts").select(F.to_date("start").alias("date"), "n")
    assert rows(streamed) == [(date(2024, 1, 1), 5)]
    stored = spark.read.parquet(str(src)).dropDuplicates(["id"])
    report = jobs.late_report(streamed, stored)
    assert rows(report, "date") == [(date(2024, 1, 1), 6, 5, 1), (date(2024, 1, 2), 1, 0, 1)]
    assert rows(jobs.repair_days(stored, report), "date") == [(date(2024, 1, 1), "view", 6), (date(2024, 1, 2), "view", 1)]


def test_stream_counts_equal_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    data = events(spark, [(i, f"s{i % 3}", 1, 7, ["view", "add_to_cart"][i % 2], f"2024-01-01 {i // 6:02d}:{i % 60:02d}:00")
                          for i in range(120)])
    drop(data, src, 0)
    # A last event far ahead closes every window before it.
    drop(events(spark, [(999, "s", 1, 7, "wishlist", "2024-02-01")]), src, 1)
    stream = jobs.read_stream(spark, "product_events", str(src), per_trigger=1)
    run(jobs.event_counts(stream, "1 hour"), "hourly")
    got = spark.table("hourly").select("start", "event_type", "n")
    assert rows(got) == rows(timelines.events_by_hour(data))


def test_sliding_revenue(spark, tmp_path):
    ddl = f"id bigint, customer_id bigint, status string, grand_total {MONEY}, placed_at timestamp"
    src = tmp_path / "in"
    drop(frame(spark, ddl, [(1, 1, "paid", "10.00", "2024-01-01 10:00:00"), (2, 1, "paid", "5.00", "2024-01-03 10:00:00"),
                            (3, 1, "cancelled", "99.00", "2024-01-03 10:00:00")]), src, 0)
    drop(frame(spark, ddl, [(4, 1, "paid", "1.00", "2024-03-01 10:00:00")]), src, 1)
    stream = jobs.read_stream(spark, "orders", str(src), per_trigger=1)
    run(jobs.sliding_revenue(stream), "sliding")
    got = {r.start.date(): float(r.revenue) for r in spark.table("sliding").collect()}
    assert got[date(2023, 12, 28)] == 15.0 and got[date(2024, 1, 2)] == 5.0 and got[date(2023, 12, 27)] == 10.0
    assert len(got) == 9


ORDER = f"id bigint, status string, channel string, grand_total {MONEY}, placed_at timestamp, _ingested_at timestamp"


def test_daily_revenue_follows_corrections(spark, tmp_path):
    src, stored, out = tmp_path / "in", str(tmp_path / "orders"), str(tmp_path / "daily")
    src.mkdir()
    schema = frame(spark, ORDER, []).schema

    def push(data, checkpoint):
        drop(frame(spark, ORDER, data), src, 0)
        stream = spark.readStream.schema(schema).parquet(str(src))
        jobs.daily_revenue_stream(stream, stored, out, str(tmp_path / checkpoint)).start().awaitTermination(120)

    push([(1, "paid", "x", "10.00", "2024-01-01 09:00:00", "2024-01-01 10:00:00"),
          (2, "pending", "x", "20.00", "2024-01-01 09:00:00", "2024-01-01 10:00:00"),
          (3, "paid", "x", "40.00", "2024-01-02 09:00:00", "2024-01-02 10:00:00")], "c")
    assert rows(spark.read.parquet(out).select("date", "revenue", "orders"), "date") == [
        (date(2024, 1, 1), 10.0, 1), (date(2024, 1, 2), 40.0, 1)]
    push([(2, "paid", "x", "20.00", "2024-01-01 09:00:00", "2024-01-01 11:00:00"),
          (3, "cancelled", "x", "40.00", "2024-01-02 09:00:00", "2024-01-02 12:00:00")], "c")
    want = [(date(2024, 1, 1), 30.0, 2), (date(2024, 1, 2), 0.0, 0)]
    assert rows(spark.read.parquet(out).select("date", "revenue", "orders"), "date") == want
    # Everything once more from the start changes nothing.
    jobs.daily_revenue_stream(spark.readStream.schema(schema).parquet(str(src)), stored, out, str(tmp_path / "again")
                              ).start().awaitTermination(120)
    assert rows(spark.read.parquet(out).select("date", "revenue", "orders"), "date") == want


def test_sessions_close_after_the_gap(spark, tmp_path):
    src = tmp_path / "in"
    data = events(spark, [
        (1, "a", 1, 7, "view", "2024-01-01 00:00:00"), (2, "a", 1, 7, "add_to_cart", "2024-01-01 23:00:00"),
        (3, "a", 1, 7, "view", "2024-01-03 00:00:00"), (4, "b", 1, 7, "add_to_cart", "2024-01-01 05:00:00"),
        (5, "b", 1, 7, "purchase", "2024-01-01 06:00:00"), (6, "c", 1, 7, "view", "2024-01-01 00:00:00"),
        (7, "c", 1, 7, "view", "2024-01-02 00:00:00")])  # exactly the gap: still the same session
    drop(data, src, 0)
    drop(events(spark, [(99, "z", 1, 7, "view", "2024-02-01")]), src, 1)
    run(jobs.cart_sessions(jobs.read_stream(spark, "product_events", str(src), per_trigger=1)), "sessions")
    got = rows(spark.table("sessions"))
    assert got == rows(timelines.sessionize(data, user="session_id"))
    assert {(r[0], r[3], r[4]) for r in got} == {
        ("a", 2, "abandoned"), ("a", 1, "browsing"), ("b", 2, "converted"), ("c", 2, "browsing")}


def test_cart_meets_order_within_a_day(spark, tmp_path):
    carts = frame(spark, "id bigint, customer_id bigint, session_id string, status string, created_at timestamp,"
                  " abandoned_at timestamp, converted_at timestamp",
                  [(1, 1, "s", "active", "2024-01-01 10:00:00", None, None), (2, 2, "s", "active", "2024-01-01 10:00:00", None, None)])
    orders = frame(spark, f"id bigint, customer_id bigint, status string, grand_total {MONEY}, placed_at timestamp", [
        (10, 1, "paid", "1.00", "2024-01-02 10:00:00"), (11, 1, "paid", "1.00", "2024-01-02 10:00:01"),
        (12, 1, "paid", "1.00", "2024-01-01 09:59:59"), (13, 2, "paid", "1.00", "2024-01-01 10:45:30"), (14, 3, "paid", "1.00", "2024-01-01")])
    drop(carts, tmp_path / "c", 0)
    drop(orders, tmp_path / "o", 0)
    joined = jobs.cart_to_order(jobs.read_stream(spark, "carts", str(tmp_path / "c")), jobs.read_stream(spark, "orders", str(tmp_path / "o")))
    run(joined, "conversion")
    assert rows(spark.table("conversion")) == [(1, 10, 1440), (2, 13, 45)]


def test_stock_totals_equal_the_running_sum(spark, tmp_path):
    ddl = "id bigint, variant_id bigint, warehouse_code string, delta bigint, reason string, ref_order_id bigint, occurred_at timestamp"
    src = tmp_path / "in"
    data = frame(spark, ddl, [(i, i % 2, "MAIN", (-1) ** i * i, "sale", None, f"2024-01-01 00:00:{i:02d}") for i in range(20)])
    drop(data.filter("id < 10"), src, 0)
    drop(data.filter("id >= 10"), src, 1)
    stream = jobs.read_stream(spark, "stock_movements", str(src), per_trigger=1)
    run(jobs.stock_totals(stream), "stock", mode="complete")
    last = timelines.stock_running(data).groupBy("variant_id", "warehouse_code").agg(F.max_by("on_hand", "occurred_at"))
    assert rows(spark.table("stock")) == rows(last)


def test_update_mode_keeps_keys_of_earlier_batches(spark, tmp_path):
    src, sink = tmp_path / "moves", str(tmp_path / "stock")
    kind = "variant_id bigint, warehouse_code string, delta bigint"
    want = {}
    for n, batch in enumerate([[(1, "A", 5), (2, "A", 7)], [(1, "A", -2), (3, None, 4)], [(3, None, 1), (1, "B", 9)]]):
        drop(frame(spark, kind, batch), src, n)
        stream = spark.readStream.schema(frame(spark, kind, batch).schema).parquet(str(src))
        keys = ["variant_id", "warehouse_code"]
        for v, w, d in batch:
            want[v, w] = want.get((v, w), 0) + d
        got = jobs.run_available(jobs.stock_totals(stream), sink, str(tmp_path / "progress"), "update", keys)
        assert {(r.variant_id, r.warehouse_code): r.on_hand for r in got.collect()} == want
    assert got.count() == len(want)
