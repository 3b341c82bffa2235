"""Products bought together, with support, confidence and lift. Exact, whatever the basket sizes.

A pair needs a share of all baskets (`min_support`, and two baskets at least), and so does each of its items; items below it are
cut before any pair is made. A basket of n remaining items is joined with itself in ceil(n / CELL) parts, so a basket of any size
is spread over tasks by its own size and a small one is not copied at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.exprs import ratio

MIN_SUPPORT = 0.0001  # share of baskets that a pair is in
CELL = 64


def _pairs(baskets: DataFrame) -> DataFrame:
    """(a, b) with a < b → number of baskets with both."""
    sizes = baskets.groupBy("order_id").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    spread = baskets.join(sizes, "order_id")
    left = spread.select("order_id", F.col("product_id").alias("a"), F.pmod(F.xxhash64("product_id"), "parts").cast("int").alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    right = spread.select("order_id", F.col("product_id").alias("b"), every)
    return left.join(right, ["order_id", "part"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def mart_product_affinity(fct_items: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Pairs found together in at least a share of `min_support` of the baskets, and in two."""
    baskets = fct_items.select("order_id", "product_id").distinct()
    total = fct_items.agg(F.countDistinct("order_id")).scalar()  # from the lines, not from the distinct baskets
    least = F.greatest(F.lit(2), F.ceil(total * F.lit(min_support)))
    support = baskets.groupBy("product_id").agg(F.count("*").alias("n_orders")).filter(F.col("n_orders") >= least)
    kept = baskets.join(support.select("product_id"), "product_id", "left_semi")
    pairs = _pairs(kept).filter(F.col("n") >= least)
    na = support.select(F.col("product_id").alias("a"), F.col("n_orders").alias("n_a"))
    nb = support.select(F.col("product_id").alias("b"), F.col("n_orders").alias("n_b"))
    return (
        pairs.join(na, "a")
        .join(nb, "b")
        .withColumn("baskets", total)
        .select(
            F.col("a").alias("product_a"),
            F.col("b").alias("product_b"),
            F.col("n").alias("orders_together"),
            ratio("n", "baskets").alias("support"),
            ratio("n", "n_a").alias("confidence_a_to_b"),
            ratio("n", "n_b").alias("confidence_b_to_a"),
            ratio(F.col("n") * F.col("baskets"), F.col("n_a") * F.col("n_b")).alias("lift"),
        )
    )
