"""Ordered work per customer or variant, cut into time buckets so no key is handled whole by one task."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stock_running(moves: DataFrame) -> DataFrame:
    """Stock on hand after each moment a variant moved in a warehouse.

    Moves of the same moment collapse first. Totals per month are run up per key and are small; inside a month the running sum
    starts from the total before it. A busy variant is spread over its months.
    """
    keys = ["variant_id", "warehouse_code"]
    moments = moves.groupBy(*keys, "occurred_at").agg(F.sum("delta").alias("delta"))
    # Never null, so both uses of `moments` below plan alike and share one shuffle.
    month = F.coalesce(F.date_trunc("MONTH", "occurred_at"), F.lit("1970-01-01").cast("timestamp_ntz").cast("timestamp"))
    moments = moments.withColumn("month", month)
    months = moments.groupBy(*keys, "month").agg(F.sum("delta").alias("month_delta"))
    upto = F.sum("month_delta").over(Window.partitionBy(*keys).orderBy("month"))
    opening = months.select(*keys, "month", (upto - F.col("month_delta")).alias("opening"))
    inside = F.sum("delta").over(Window.partitionBy(*keys, "month").orderBy("occurred_at"))
    return moments.join(opening, [*keys, "month"]).select(
        *keys, "occurred_at", "delta", (F.col("opening") + inside).alias("on_hand")
    )


def sessionize(events: DataFrame, gap: timedelta = timedelta(hours=24), user: str = "user_id") -> DataFrame:
    """Sessions per user: a longer pause than `gap` starts a new one; `abandoned` if nothing was bought.

    Events of one user within a bucket no wider than the gap always share a session, so they
    collapse to first, last and count before the per-user step.
    """
    bucket_seconds = max(int(gap.total_seconds() // 4), 1)
    seconds = F.unix_timestamp("occurred_at")
    added = F.col("event_type") == "add_to_cart"
    bought = F.col("event_type") == "purchase"
    buckets = events.groupBy(user, F.floor(seconds / bucket_seconds).alias("bucket")).agg(
        F.min("occurred_at").alias("first"),
        F.max("occurred_at").alias("last"),
        F.count("*").alias("n"),
        F.count_if(added).alias("adds"),
        F.count_if(bought).alias("buys"),
    )
    along = Window.partitionBy(user).orderBy("bucket")
    idle_us = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(
        F.lag("last").over(along).cast("timestamp")
    )
    starts = F.coalesce((idle_us > int(gap.total_seconds()) * 1_000_000).cast("int"), F.lit(1))
    sessions = (
        buckets.withColumn("starts", starts)
        .withColumn("session", F.sum("starts").over(along))
        .groupBy(user, "session")
        .agg(
            F.min("first").alias("session_start"),
            F.max("last").alias("session_end"),
            F.sum("n").alias("n_events"),
            F.sum("adds").alias("adds"),
            F.sum("buys").alias("buys"),
        )
    )
    status = F.when(F.col("buys") > 0, "converted").when(F.col("adds") > 0, "abandoned").otherwise("browsing")
    return sessions.select(user, "session_start", "session_end", "n_events", status.alias("status"))


def events_by_hour(events: DataFrame) -> DataFrame:
    """Event counts per hour and type; the batch twin of the streaming counts."""
    return events.groupBy(F.date_trunc("HOUR", "occurred_at").alias("hour"), "event_type").agg(
        F.count("*").alias("n")
    )
