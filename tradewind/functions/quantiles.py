"""Exact quantiles per group without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], bucket_width: float
) -> DataFrame:
    """Interpolated quantiles of `value` per key, plus `n`.

    Rows collapse to (key, value) counts first. A second, much smaller count per (key, bucket)
    finds the buckets that hold the wanted ranks, and only those buckets are ranked value by value.
    A group with a third of all rows is therefore spread over its values and then its buckets.
    """
    bucket = F.floor(F.col(value) / F.lit(bucket_width))
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"), bucket.alias("_b"))
        .agg(F.count("*").alias("_c"))
    )
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    running = Window.partitionBy(*keys).orderBy("_b")
    ranked = by_bucket.select(
        *keys,
        "_b",
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.sum("_c").over(running).alias("_upto"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"),
    )

    def rank(q: float):
        return F.col("n").cast("double").__sub__(1) * F.lit(q)

    def holds(q: float, before: str, upto: str):
        low, high = F.floor(rank(q)), F.ceil(rank(q))
        return ((low >= F.col(before)) & (low < F.col(upto))) | (
            (high >= F.col(before)) & (high < F.col(upto))
        )

    wanted = F.lit(False)
    for q in quantiles.values():
        wanted = wanted | holds(q, "_before", "_upto")
    hit = ranked.filter(wanted)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}"))
    within = Window.partitionBy(*keys, "_b").orderBy("_v")
    values = (
        counts.alias("c")
        .join(hit.alias("h"), same & (F.col("c._b") == F.col("h._b")))
        .select(*[F.col(f"c.{k}") for k in keys], F.col("c._b"), "_v", "c._c", "_before", "n")
        .withColumn("_end", F.col("_before") + F.sum("_c").over(within))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    aggs = []
    for name, q in quantiles.items():
        low, high = F.floor(rank(q)), F.ceil(rank(q))
        at_low = F.max(F.when((low >= F.col("_start")) & (low < F.col("_end")), F.col("_v")))
        at_high = F.max(F.when((high >= F.col("_start")) & (high < F.col("_end")), F.col("_v")))
        part = F.max(rank(q) - low)
        aggs.append((at_low + (at_high - at_low) * part).alias(name))
    return values.groupBy(*keys, "n").agg(*aggs)
