"""Structured Streaming jobs over the click log, carts, orders and stock movements.

Event-time columns are TIMESTAMP (a watermark needs one). Writers go through foreachBatch into
partitions named after the batch or the touched dates, so a batch that runs twice writes the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tradewind.functions.predicates import recognized
from tradewind.operators.etl import load_fact, reconcile
from tradewind.schemas import ENTITIES, EVENT_TYPES, SESSION_ID_MAX
from tradewind.sources.tables import DATE_PARTITION
from tradewind.streaming.keyed_sink import KeyedSink

DELAY = "2 hours"  # fixed value: pulls overlap by two hours, so rows may arrive that late


def read_stream(spark: SparkSession, entity: str, path: str, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Files of one entity as they arrive, by the declared schema."""
    return (
        spark.readStream.schema(ENTITIES[entity]).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)
    )


def _once(writer: DataStreamWriter, checkpoint: str) -> DataStreamWriter:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_available(
    stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", keys: Sequence[str] = ()
) -> DataFrame:
    """Process what has arrived, then hand back the stored result.

    Complete results replace the last one; updates are merged into the sink by `keys`.
    """
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", sink)
    elif mode == "update":
        if not keys:
            raise ValueError("update mode needs the keys of the result")
        table = KeyedSink(spark, sink, keys)
        writer = stream.writeStream.outputMode(mode).foreachBatch(table.write)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(sink)
        )
    _once(writer, checkpoint).start().awaitTermination()
    return table.read(stream.schema) if mode == "update" else spark.read.schema(stream.schema).parquet(sink).select(*stream.columns)


# ---- ingest -----------------------------------------------------------------------------------------


def with_default_type(events: DataFrame) -> DataFrame:
    return events.withColumn("event_type", F.coalesce("event_type", F.lit("view")))


def rejection(events_type: str = "event_type") -> Column:
    """Why an event is refused; null for a good one."""
    return (
        F.when(F.col("session_id").isNull(), "no session_id")
        .when(F.length("session_id") > SESSION_ID_MAX, "session_id too long")
        .when(F.col("product_id").isNull(), "no product_id")
        .when(~F.col(events_type).isin(*EVENT_TYPES), "unknown event_type")
    )


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def ingest_events(events: DataFrame, valid_path: str, quarantine_path: str, checkpoint: str) -> DataStreamWriter:
    """Good events to one table, refused ones with the reason to another."""
    checked = with_default_type(events).withColumn("reason", rejection())

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read and checked once for both outputs; a lost block is computed again
        try:
            _write_batch(batch.filter("reason is null").drop("reason"), batch_id, valid_path)
            _write_batch(batch.filter("reason is not null"), batch_id, quarantine_path)
        finally:
            batch.unpersist()

    return _once(checked.writeStream.foreachBatch(split), checkpoint)


def dedupe_stream(stream: DataFrame, key: str = "id", time: str = "occurred_at", delay: str = DELAY) -> DataFrame:
    """Rows pulled twice by overlapping windows pass once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


# ---- windows ----------------------------------------------------------------------------------------


def event_counts(
    stream: DataFrame,
    width: str = "1 hour",
    slide: str | None = None,
    time: str = "occurred_at",
    delay: str | None = DELAY,
) -> DataFrame:
    """Counts per window and event type. After `dedupe_stream`, which sets the watermark, pass delay=None."""
    return (
        (stream.withWatermark(time, delay) if delay else stream)
        .groupBy(F.window(time, width, slide), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
    )


def sliding_revenue(orders: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Recognized revenue over a sliding window."""
    return (
        orders.filter(recognized())
        .withWatermark("placed_at", delay)
        .groupBy(F.window("placed_at", width, slide))
        .agg(F.sum("grand_total").alias("revenue"), F.count("*").alias("orders"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "revenue", "orders")
    )


# ---- daily revenue, kept current ---------------------------------------------------------------------


def refresh_days(spark: SparkSession, orders_path: str, out_path: str, parts: DataFrame) -> None:
    """Recompute the revenue of the days in the partitions `parts` from the stored orders and replace just those."""
    touched = spark.read.parquet(orders_path).join(parts, DATE_PARTITION, "left_semi")
    daily = (
        touched.filter(recognized())
        .groupBy(DATE_PARTITION, F.to_date("placed_at").alias("date"))
        .agg(F.sum("grand_total").alias("revenue"), F.count("*").alias("orders"))
    )
    # A touched partition that lost its last recognized order is written with a zero, not left as it was.
    full = parts.join(daily, DATE_PARTITION, "left").select(
        DATE_PARTITION,
        F.coalesce("date", DATE_PARTITION).alias("date"),
        F.coalesce("revenue", F.lit(0)).cast("decimal(22,2)").alias("revenue"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
    )
    (
        full.repartition(DATE_PARTITION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE_PARTITION)
        .parquet(out_path)
    )


def daily_revenue_stream(
    orders: DataFrame, orders_path: str, out_path: str, checkpoint: str, grain: str = "DAY"
) -> DataStreamWriter:
    """Merge each batch into the stored orders, then refresh the partitions it touched.

    `orders` carries `_ingested_at`, which decides between versions of one order.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        parts = load_fact(batch, "orders", orders_path, "placed_at", grain=grain)
        refresh_days(batch.sparkSession, orders_path, out_path, parts.filter(f"{DATE_PARTITION} is not null"))

    return _once(orders.writeStream.foreachBatch(merge), checkpoint)


# ---- sessions and conversion --------------------------------------------------------------------------


def cart_sessions(events: DataFrame, gap: str = "24 hours", delay: str = DELAY) -> DataFrame:
    """Sessions per visitor, closed after `gap` without an event; abandoned if a cart was left behind."""
    added = F.count_if(F.col("event_type") == "add_to_cart")
    bought = F.count_if(F.col("event_type") == "purchase")
    status = F.when(F.col("buys") > 0, "converted").when(F.col("adds") > 0, "abandoned").otherwise("browsing")
    return (
        events.withWatermark("occurred_at", delay)
        .groupBy("session_id", F.session_window("occurred_at", gap))
        .agg(
            F.min("occurred_at").alias("session_start"),
            F.max("occurred_at").alias("session_end"),
            F.count("*").alias("n_events"),
            added.alias("adds"),
            bought.alias("buys"),
        )
        .select("session_id", "session_start", "session_end", "n_events", status.alias("status"))
    )


def cart_to_order(carts: DataFrame, orders: DataFrame, within: str = "24 hours", delay: str = DELAY) -> DataFrame:
    """Orders a customer placed within `within` of opening a cart. Both sides forget old rows."""
    c = carts.select(
        F.col("id").alias("cart_id"), F.col("customer_id").alias("cart_customer"), "created_at"
    ).withWatermark("created_at", delay)
    o = orders.select(F.col("id").alias("order_id"), "customer_id", "placed_at").withWatermark("placed_at", delay)
    on = (
        (F.col("cart_customer") == F.col("customer_id"))
        & (F.col("placed_at") >= F.col("created_at"))
        & (F.col("placed_at") <= F.col("created_at") + F.expr(f"INTERVAL {within}"))
    )
    return c.join(o, on).select(
        "cart_id", "order_id", F.timestamp_diff("MINUTE", F.col("created_at"), F.col("placed_at")).alias("minutes")
    )


def stock_totals(moves: DataFrame) -> DataFrame:
    """Stock on hand per variant and warehouse; write in update mode with these two as keys."""
    return moves.groupBy("variant_id", "warehouse_code").agg(F.sum("delta").alias("on_hand"))


# ---- late rows ----------------------------------------------------------------------------------------


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that a finished run refused because they came after its watermark, by the run's own progress.

    Behind `dedupe_stream` these are rows: the operator that dedupes meets them one by one. An aggregation would count groups that it
    had already combined.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def deduped_pull(pulled: DataFrame, sink: str, checkpoint: str, time: str = "occurred_at") -> int:
    """Everything that has arrived, deduplicated into `sink`; returns how many rows came too late to be taken."""
    writer = dedupe_stream(pulled, time=time).writeStream.format("parquet").option("path", sink)
    query = _once(writer, checkpoint).start()
    query.awaitTermination()
    return dropped_by_watermark(query)


def late_report(streamed: DataFrame, stored: DataFrame, time: str = "occurred_at") -> DataFrame:
    """Per date, how many stored rows the stream never counted. `streamed`: date, n."""
    per_row = stored.select(time)
    counted = streamed.groupBy("date").agg(F.sum("n").alias("n_streamed"))
    batch = per_row.groupBy(F.to_date(time).alias("date")).agg(F.count("*").alias("n_stored"))
    missing = F.col("n_stored") - F.coalesce("n_streamed", F.lit(0))
    return batch.join(counted, "date", "left").select(
        "date", "n_stored", F.coalesce("n_streamed", F.lit(0)).alias("n_streamed"), missing.alias("dropped")
    )


def repair_days(stored: DataFrame, report: DataFrame, time: str = "occurred_at") -> DataFrame:
    """Counts of the days that lost rows, recomputed from the stored events."""
    bad = report.filter("dropped <> 0").select("date")
    return (
        stored.withColumn("date", F.to_date(time))
        .join(bad, "date", "left_semi")
        .groupBy("date", "event_type")
        .agg(F.count("*").alias("n"))
    )


def drift(source: DataFrame, target: DataFrame, time: str) -> DataFrame:
    return reconcile(source, target, time).filter("is_drift")
