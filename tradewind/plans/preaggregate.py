"""Orders added up per day, channel and device, and metric questions answered from that instead of from the orders.

What is stored can be added up again: sums and counts, a mergeable sketch of the customers, and a mergeable quantile sketch of the
order totals. Averages are put together from sums on reading. `answer` decides from a question alone whether the stored rows cover it:
measures that can be merged, dimensions and filters that are kept, a period made of whole days. If so it asks the same metric
layer with the stored rows in place of the orders; if not it asks the orders, so the rows are the same either way.

A refresh recomputes whole months from a date on and replaces those months only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.exprs import date_lit, ratio
from tradewind.functions.money import cents, money
from tradewind.functions.predicates import not_cancelled
from tradewind.plans.metrics import Cube, Model, _split, metric_query

CUBE, TIME = "Orders", "placed_at"
DIMENSIONS = ("channel", "device_type")
GRAINS = ("day", "week", "month", "quarter", "year")
STORED = (
    "day date, channel string, device_type string, orders long, priced long, revenue_cents long, discount_cents long,"
    " customers binary, totals binary, month date"
)
EXACT = ("count", "revenue", "discount", "aov")
APPROXIMATE = ("unique_customers", "median_total")  # given only when asked for


def _measures() -> dict[str, Column]:
    """Every measure, put together from stored columns."""
    return {
        "count": F.coalesce(F.sum("orders"), F.lit(0)),
        "revenue": money(F.sum("revenue_cents")),
        "discount": money(F.sum("discount_cents")),
        "aov": ratio(money(F.sum("revenue_cents")), F.sum("priced")),
        "unique_customers": F.hll_sketch_estimate(F.hll_union_agg("customers")),
        "median_total": F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("totals"), F.lit(0.5)) / 100,
    }


def _per_day(orders: DataFrame) -> DataFrame:
    """Customers and channels collapse to one row per day first, so a busy key reaches the sketches as few rows a task."""
    total = cents("grand_total")
    return (
        orders.groupBy(F.to_date("placed_at").alias("day"), *DIMENSIONS)
        .agg(
            F.count("*").alias("orders"),
            F.count("grand_total").alias("priced"),
            F.sum(total).alias("revenue_cents"),
            F.sum(cents("discount_total")).alias("discount_cents"),
            F.hll_sketch_agg("customer_id").alias("customers"),
            F.kll_sketch_agg_bigint(total).alias("totals"),
        )
        .withColumn("month", F.trunc("day", "MONTH").cast("date"))
    )


def refresh(orders: DataFrame, path: str, since: date) -> None:
    """Recompute the months from `since` on, and the orders without a time. A month whose orders were all cancelled is emptied,
    not left as it was."""
    first = since.replace(day=1)
    recent = orders.filter(F.col("placed_at").isNull() | (F.to_date("placed_at") >= date_lit(first)))
    live = _per_day(recent.filter(not_cancelled()))
    months = recent.select(F.trunc("placed_at", "MONTH").cast("date").alias("month")).distinct()
    empty = months.join(live.select("month").distinct(), "month", "left_anti")
    rows = live.unionByName(empty, allowMissingColumns=True)
    (
        rows.hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path).filter("orders > 0")


def uncovered(
    measures: Sequence[str],
    dimensions: Sequence[str] = (),
    time_dimension: str | None = None,
    granularity: str | None = None,
    segments: Sequence[str] = (),
    approximate: bool = False,
) -> str | None:
    """Why the stored rows cannot answer a question; None if they can."""
    known = EXACT + (APPROXIMATE if approximate else ())
    for member in (*measures, *dimensions, *([time_dimension] if time_dimension else []), *segments):
        if _split(member)[0] != CUBE:
            return f"{member} belongs to another table"
    for member in measures:
        if _split(member)[1] not in known:
            return f"{member} cannot be added up"
    for member in dimensions:
        if _split(member)[1] not in DIMENSIONS:
            return f"{member} is not kept"
    if segments:
        return "segments are not kept"
    if time_dimension and _split(time_dimension)[1] != TIME:
        return f"{time_dimension} is not kept"
    if granularity and granularity not in GRAINS:
        return f"{granularity} is finer than a day"
    return None


def _in_place_of_orders(rows: DataFrame, dates: tuple[date, date] | None) -> Model:
    """The metric layer's own cube over the stored rows. Months outside the period are not opened."""
    if dates:
        first, last = (date_lit(d.replace(day=1)) for d in dates)
        rows = rows.filter((F.col("month") >= first) & (F.col("month") <= last))
    dimensions = {d: F.col(d) for d in DIMENSIONS} | {TIME: F.col("day")}
    return {CUBE: Cube(rows=lambda: rows, key="day", measures=_measures(), dimensions=dimensions)}


def answer(
    model: Model,
    stored: DataFrame,
    measures: Sequence[str],
    dimensions: Sequence[str] = (),
    time_dimension: str | None = None,
    granularity: str | None = None,
    dates: tuple[date, date] | None = None,
    segments: Sequence[str] = (),
    order: Sequence[tuple[str, str]] = (),
    limit: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """The metric question, from `stored` where that covers it and from the model's own tables otherwise."""
    if uncovered(measures, dimensions, time_dimension, granularity, segments, approximate) is None:
        model = _in_place_of_orders(stored, dates if time_dimension else None)
    return metric_query(model, measures, dimensions, time_dimension, granularity, dates, segments, order, limit)
