"""Joins by size: sums of a fact by attributes of a dimension, and sides that Spark takes for smaller than they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side as long as the catalog, joined by shuffle and sort whatever size Spark expects of it.

    Spark's limit for broadcasts goes by the length of the files. Rows that come out of an explode, and texts that repeat and so
    take little room in a file, are many times that size in memory, and a broadcast passes whole through the driver.
    """
    return df.hint("merge")


def sums_by_attribute(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    by: Sequence[str],
    sums: Mapping[str, Column],
    fact_by: Sequence[str] = (),
) -> DataFrame:
    """Sums of `sums` by attributes of `dimension` (`by`) and of the fact (`fact_by`).

    The fact is summed per key before it meets the dimension, so that a key with a large share of the rows reaches the join
    as a few rows. Whether the dimension is broadcast is left to Spark and its byte limit.
    """
    per_key = fact.groupBy(key, *fact_by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    slim = dimension.select(key, *by)
    return per_key.join(slim, key).groupBy(*by, *fact_by).agg(*[F.sum(n).alias(n) for n in sums])
