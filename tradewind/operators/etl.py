"""Loads that can be run twice: extract, stage, dedupe, load by partition, reconcile, keep history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.functions.exprs import col, date_lit, ts_lit
from tradewind.operators.key_index import KeyIndex
from tradewind.session import run_path
from tradewind.sources.tables import DATE_PARTITION, partition_date, read_jsonl, write_entity, write_jsonl

PULL_HOURS = 2  # fixed value: the hourly pull looks back two hours, so pulls overlap

# Which tables are reloaded whole, and the time column of the others.
FULL_TABLES = ("categories", "products", "product_variants", "promotions")
WINDOW_COLUMNS = {
    "customers": "created_at",
    "orders": "placed_at",
    "stock_movements": "occurred_at",
    "carts": "created_at",
    "product_events": "occurred_at",
    "inventory_levels": "updated_at",
    "promotion_redemptions": "redeemed_at",
}


# ---- extract -----------------------------------------------------------------------------------


def incremental_window(df: DataFrame, column: str, as_of: datetime, hours: int = PULL_HOURS) -> DataFrame:
    return df.filter(F.col(column) >= ts_lit(as_of - timedelta(hours=hours)))


def incremental_items(
    order_items: DataFrame, orders: DataFrame, as_of: datetime, hours: int = PULL_HOURS
) -> DataFrame:
    """Lines carry no time; they follow the orders of the window."""
    recent = incremental_window(orders, "placed_at", as_of, hours).select(F.col("id").alias("order_id"))
    return order_items.join(recent, "order_id", "left_semi")


def jsonl_roundtrip(df: DataFrame, name: str) -> DataFrame:
    """Stage as JSON lines in the shared folder and read back by the same schema."""
    path = run_path(df.sparkSession, f"jsonl-{name}")
    write_jsonl(df, path)
    return read_jsonl(df.sparkSession, path, df.schema)


# ---- load ---------------------------------------------------------------------------------------


def dedupe_latest(raw: DataFrame, pk: Sequence[str], newest: Sequence[str] = ("_ingested_at",)) -> DataFrame:
    """One row per key: the newest, any remaining tie settled by content.

    The rank filter is applied before the shuffle too, so copies of one key are dropped where they are read.
    """
    rest = [c for c in raw.columns if c not in (*pk, *newest)]
    content = F.xxhash64(*[F.col(c) for c in rest]) if rest else F.lit(0)
    latest = Window.partitionBy(*pk).orderBy(*[F.desc_nulls_last(c) for c in newest], content)
    return raw.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def full_refresh(df: DataFrame, path: str) -> DataFrame:
    """Replace a small table and hand back what was stored."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The table at `path` with the columns of `like`, or None if there is none yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        # Only a table that is not there yet counts as absent; any other trouble stops the load.
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    found.select(*like.columns)  # a table that lost a column is refused
    return spark.read.schema(like.schema).parquet(path)


def _remove_partitions(spark: SparkSession, path: str, days: Sequence[date | None]) -> None:
    """Delete date partitions that hold no row any more; the file system is the table's own."""
    jvm = spark._jvm
    for day in days:
        name = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{DATE_PARTITION}={name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def load_fact(
    incoming: DataFrame,
    entity: str,
    path: str,
    time_column: str,
    pk: Sequence[str] = ("id",),
    newest: Sequence[str] = ("_ingested_at",),
    grain: str = "DAY",
    reads: Observation | None = None,
) -> DataFrame:
    """Merge a pull into its date partitions: same pull twice, same table.

    The pull is staged once, one row per key. Touched are its own dates and those under which the key index has its keys, so
    a row whose time moved leaves its old date. Rows without a time have a partition of their own and are matched like any
    other. Only touched partitions are opened and replaced; of all others nothing is read. The merged rows are staged in the
    shared folder first, so a failed run leaves the table as it was or is mended by the next. A table that is reloaded over
    years may be cut by a coarser `grain` (MONTH). `reads` counts the stored rows that were read. Returns the touched
    partitions.
    """
    spark = incoming.sparkSession
    day = partition_date(time_column, grain)
    stage = run_path(spark, f"stage-{entity}")

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    pull = staged(dedupe_latest(incoming, pk, newest).withColumn(DATE_PARTITION, day), "pull")
    keys = KeyIndex(spark, path, pk)
    stored = stored_table(spark, path, pull)
    if stored is None:
        keys.add(pull)
        write_entity(pull.drop(DATE_PARTITION), entity, path, grain=grain)
        return pull.select(DATE_PARTITION).distinct()
    if keys.stored(pull) is None:
        keys.rebuild(stored)
    places = keys.near(pull).select(DATE_PARTITION).unionByName(pull.select(DATE_PARTITION)).distinct()
    days = [r[0] for r in places.collect()]  # dates of partitions only
    keys.add(pull)
    known = [d for d in days if d is not None]
    touched = F.col(DATE_PARTITION).isin(known) if known else F.lit(False)
    if None in days:
        touched = touched | F.col(DATE_PARTITION).isNull()
    within = stored.filter(touched)
    before = {r[0] for r in within.select(DATE_PARTITION).distinct().collect()}
    opened = within.observe(reads, F.count("*").alias("rows_read")) if reads else within
    rows = staged(dedupe_latest(pull.unionByName(opened).drop(DATE_PARTITION), pk, newest), "merged")
    after = {r[0] for r in rows.select(day).distinct().collect()}
    write_entity(rows, entity, path, grain=grain)
    _remove_partitions(spark, path, sorted(before - after, key=str))
    return spark.createDataFrame([(d,) for d in days], f"{DATE_PARTITION} date")


def bootstrap(tables: Mapping[str, DataFrame], root: str, ingested_at: datetime) -> dict[str, int]:
    """Copy every non-empty table under `root`; the count rides on the write, not on a second scan."""
    counts = {}
    for name, df in tables.items():
        if df.isEmpty():
            counts[name] = 0
            continue
        seen = Observation(name)
        stamped = df.withColumn("_ingested_at", ts_lit(ingested_at)).observe(seen, F.count("*").alias("n"))
        stamped.write.mode("overwrite").parquet(f"{root}/{name}")
        counts[name] = seen.get["n"]
    return counts


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# ---- reconcile -----------------------------------------------------------------------------------


def reconcile(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Row counts per date on both sides; a date missing on one side counts zero there."""
    def per_day(df: DataFrame, source: int) -> DataFrame:
        return df.groupBy(F.to_date(column).alias("date")).agg(
            (F.count("*") * source).alias("n_source"), (F.count("*") * (1 - source)).alias("n_target")
        )

    # Rows without a date are a date of their own, so both sides are added up rather than joined.
    both = per_day(source, 1).unionByName(per_day(target, 0)).groupBy("date")
    return both.agg(F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target")).select(
        "*",
        (F.col("n_source") - F.col("n_target")).alias("drift"),
        (F.col("n_source") != F.col("n_target")).alias("is_drift"),
    )


# ---- history -------------------------------------------------------------------------------------


def scd2(
    snapshots: DataFrame, key: str, tracked: Sequence[str], at: str = "snapshot_date", complete: bool = False
) -> DataFrame:
    """Versions with valid_from / valid_to (open end: null) from dated snapshots.

    With `complete` snapshots a key missing from the next snapshot date was deleted, and its version
    ends there. Otherwise a snapshot only reports the keys seen that day.
    """
    along = Window.partitionBy(key).orderBy(at)
    state = F.struct(*[F.col(c) for c in tracked])
    rows = snapshots.select(key, at, *tracked)
    if complete:
        dates = rows.select(at).distinct()
        following = dates.select(F.col(at), F.lead(at).over(Window.orderBy(at)).alias("_next"))
        rows = rows.join(following, at)
    else:
        rows = rows.withColumn("_next", F.lit(None).cast("date"))
    gone_between = F.coalesce(F.lag("_next").over(along) != F.col(at), F.lit(False))
    changed = ~state.eqNullSafe(F.lag(state).over(along)) | gone_between
    versions = (
        rows.withColumn("_starts", changed.cast("int"))
        .withColumn("_version", F.sum("_starts").over(along))
        .groupBy(key, "_version")
        .agg(
            F.min(at).alias("valid_from"),
            F.max_by("_next", at).alias("_ends"),
            *[F.max(c).alias(c) for c in tracked],
        )
    )
    next_version = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    valid_to: Column = F.col("_ends") if complete else next_version
    return versions.select(key, *tracked, "valid_from", valid_to.alias("valid_to"))


def as_of(history: DataFrame, day: date) -> DataFrame:
    """The versions in force on `day`."""
    d = date_lit(day)
    return history.filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))


def version_on(days: DataFrame, history: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """The version in force for each (key, day) of `days`.

    Versions and days are laid on one line per key and the last version is carried forward, so no
    day is compared with every version. `days` should hold distinct (key, day) pairs.
    """
    state = F.struct("valid_to", *tracked)
    starts = history.select(key, F.col("valid_from").alias(at), state.alias("_v"), F.lit(0).alias("_kind"))
    asked = days.select(key, at, F.lit(None).cast(starts.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_kind"))
    along = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = starts.unionByName(asked).withColumn("_v", F.last("_v", ignorenulls=True).over(along)).filter("_kind = 1")
    in_force = F.col("_v.valid_to").isNull() | (F.col(at) < F.col("_v.valid_to"))
    return carried.select(key, at, *[F.when(in_force, F.col(f"_v.{c}")).alias(c) for c in tracked])


def facts_in_force(facts: DataFrame, history: DataFrame, key: str, at: str, tracked: Sequence[str]) -> DataFrame:
    """Every fact with the version of `key` in force on its date; null where none was.

    Only distinct (key, date) pairs are laid against the versions, so a key with a large share of the facts is as long as
    the calendar there. The facts meet the result by key and date, which spreads a hot key over its dates.
    """
    found = version_on(facts.select(key, at).distinct(), history, key, at, tracked)
    return facts.join(found, [key, at], "left")


# ---- small result files --------------------------------------------------------------------------


def write_forecast_json(forecast: DataFrame, path: str) -> None:
    forecast.orderBy("forecast_date").coalesce(1).write.mode("overwrite").json(path)


def write_category_csv(forecast: DataFrame, path: str) -> None:
    forecast.write.mode("overwrite").partitionBy("category_name").option("header", "true").csv(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One record per series with its error and coverage."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics_json(like: DataFrame, path: str) -> DataFrame:
    """The stored records with the columns of `like`."""
    return like.sparkSession.read.schema(like.schema).json(path)


def pull_report(pulls: Mapping[str, DataFrame]) -> DataFrame:
    """Every row of every pull as (table, id, time)."""
    out = None
    for table, df in pulls.items():
        rows = df.select(F.lit(table).alias("table"), F.col("id").alias("row_id"), col(WINDOW_COLUMNS[table]).alias("changed_at"))
        out = rows if out is None else out.unionByName(rows)
    return out
