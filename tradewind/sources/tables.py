"""Reading and laying out entity tables: Parquet, JSON lines, CSV and JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.schemas import ENTITIES, LAYOUT

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
DATE_PARTITION = "dt"


def read_entity(spark: SparkSession, entity: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """An entity by its declared schema; nothing is inferred."""
    reader = spark.read.schema(ENTITIES[entity]).options(**options)
    if fmt == "json":
        reader = reader.option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT)
    if fmt == "csv":
        reader = reader.option("header", "true").option("timestampFormat", TS_FORMAT)
    return reader.format(fmt).load(path)


def read_jdbc(
    spark: SparkSession, url: str, entity: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """An entity from a database, pulled in parallel key ranges."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=entity,
        partitionColumn=key,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
        **options,
    )
    return reader.load()


def write_jsonl(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON: timestamps as ISO-8601, decimals as text."""
    text = [
        F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
        for f in df.schema.fields
    ]
    (
        df.select(*text)
        .write.mode("overwrite")
        .option("timestampFormat", TS_FORMAT)
        .option("timestampNTZFormat", TS_FORMAT)
        .json(path)
    )


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("timestampFormat", TS_FORMAT)
        .option("timestampNTZFormat", TS_FORMAT)
        .json(path)
    )


def partition_date(time_column: str, grain: str = "DAY") -> Column:
    """The date that names a row's partition: its day, or the first day of its `grain`."""
    return F.to_date(time_column) if grain == "DAY" else F.to_date(F.date_trunc(grain, F.col(time_column)))


def write_entity(df: DataFrame, entity: str, path: str, mode: str = "overwrite", grain: str = "DAY") -> None:
    """Date partitions with rows clustered inside. Spark splits a busy date into several tasks by its size."""
    time_column, cluster = LAYOUT.get(entity, (None, ()))
    if time_column is None:
        df.write.mode(mode).parquet(path)
        return
    dated = df.withColumn(DATE_PARTITION, partition_date(time_column, grain))
    (
        dated.hint("rebalance", DATE_PARTITION)
        .sortWithinPartitions(DATE_PARTITION, *cluster)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE_PARTITION)
        .parquet(path)
    )
