"""Order lines stored by the date of their order.

Lines carry no date: a job over a window of dates would have to read every line there is. The store holds each line under the
date of its order, clustered by order, so such a job opens only the partitions of its window. It is built once for each state of
the source files and serves every windowed job of the application.

A line without a known order, or whose order appears with several dates, lies in the partition without a date, which every
window reads. So a window may see more lines than it needs, never fewer; the job's own join with its orders decides.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.exprs import date_lit
from tradewind.functions.sizing import by_shuffle
from tradewind.session import file_states, run_path
from tradewind.sources.tables import DATE_PARTITION, partition_date

# A partition should hold at least this much of the source; below it days are put together as months, months as years.
PARTITION_BYTES = 64 << 20
DAYS_OF = {"DAY": 1, "MONTH": 30, "YEAR": 365}
SMALLEST_GRAIN_FILES = 128  # with fewer partitions than this in all, small ones do no harm

# Stores by application and source state, and the listed table of each session: its files are listed once.
_built: dict[tuple[str, str, str], tuple[str, str]] = {}
_listed: dict[tuple[str, str], DataFrame] = {}


def choose_grain(source_bytes: int, days: int) -> str:
    """The finest grain whose partitions are large enough, or that has few partitions anyway."""
    for grain, length in DAYS_OF.items():
        parts = max(1, days // length)
        if source_bytes >= parts * PARTITION_BYTES or parts <= SMALLEST_GRAIN_FILES:
            return grain
    return "YEAR"


def order_dates(orders: DataFrame, key: str, time_column: str, grain: str) -> DataFrame:
    """One row per order key: its partition date, null if its rows disagree."""
    day = partition_date(time_column, grain)
    spread = orders.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    return spread.select(key, F.when(F.col("_from") == F.col("_to"), F.col("_from")).alias(DATE_PARTITION))


def with_dates(lines: DataFrame, orders: DataFrame, line_key: str, order_key: str, time_column: str, grain: str) -> DataFrame:
    """Lines with their partition date. The dates of all orders are as long as the orders, so they are never broadcast."""
    dates = order_dates(orders, order_key, time_column, grain)
    dated = lines.join(by_shuffle(dates), F.col(line_key) == F.col(order_key), "left")
    return dated.select(*lines.columns, DATE_PARTITION)


def build(lines: DataFrame, orders: DataFrame, line_key: str, order_key: str, time_column: str, path: str, grain: str) -> None:
    """Write the store. Lines of one date are split by size, not by a fixed count of files."""
    (
        with_dates(lines, orders, line_key, order_key, time_column, grain)
        .hint("rebalance", DATE_PARTITION)
        .sortWithinPartitions(DATE_PARTITION, line_key)
        .write.partitionBy(DATE_PARTITION)
        .parquet(path)
    )


def in_window(first: date, last: date, grain: str) -> Column:
    """Partitions that may hold lines of orders dated `first` to `last`."""
    start = {"DAY": first, "MONTH": first.replace(day=1), "YEAR": first.replace(month=1, day=1)}[grain]
    dt = F.col(DATE_PARTITION)
    return dt.isNull() | ((dt >= date_lit(start)) & (dt <= date_lit(last)))


def read(spark: SparkSession, path: str, schema: str, first: date, last: date, grain: str) -> DataFrame:
    key = (spark._jsparkSession.sessionUUID(), path)
    if key not in _listed:
        _listed[key] = spark.read.schema(f"{schema}, {DATE_PARTITION} date").parquet(path)
    return _listed[key].filter(in_window(first, last, grain)).drop(DATE_PARTITION)


def ensure(
    spark: SparkSession,
    line_path: str,
    order_path: str,
    lines: DataFrame,
    orders: DataFrame,
    line_key: str,
    order_key: str,
    time_column: str,
) -> tuple[str, str]:
    """Path and grain of the store for these source files, built if this application has none for their present state."""
    states = [file_states(spark, p) for p in (line_path, order_path)]
    state = hashlib.sha256(repr(states).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, line_path, state)
    if key not in _built:
        low, high = orders.agg(F.min(time_column), F.max(time_column)).first()
        days = (high - low).days + 1 if low else 1
        grain = choose_grain(sum(size for _, size, _ in states[0]), days)
        path = run_path(spark, "line-store")
        build(lines, orders, line_key, order_key, time_column, path, grain)
        _built[key] = (path, grain)
    return _built[key]
