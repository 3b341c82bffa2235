"""Items found together, beyond pairs: every set of up to `max_size` items that enough baskets hold.

Level by level. A set can only be frequent if all its parts are, so an occurrence of a frequent set in a basket is lengthened by
later items of that basket, and the lengthened set is counted only if each set that leaves one item out is frequent as
well. Occurrences stay rows spread by basket and set; no basket is gathered into an array. What survives a level is staged in
the shared folder, so a later level reads it instead of computing it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.exprs import ratio
from tradewind.session import run_path


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = run_path(df.sparkSession, f"itemsets-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent_itemsets(lines: DataFrame, basket: str, item: str, min_support: float, max_size: int = 3) -> DataFrame:
    """items (ascending), size, n (baskets that hold them all) and their share of all baskets.

    A set needs a share of `min_support` of the baskets, and two baskets at least. Lines without a basket or an item do not count;
    an item that a basket repeats counts once.
    """
    if not 0 < min_support <= 1 or max_size < 1:
        raise ValueError("min_support is a share above 0, max_size at least 1")
    held = lines.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    total = held.agg(F.countDistinct("basket").alias("n")).first()["n"]
    least = max(2, -(-total * min_support // 1))

    def counted(occurrences: DataFrame) -> DataFrame:
        return occurrences.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= least)

    occurrences = _staged(held.withColumn("items", F.array("item")).drop("item"), "held")
    found = [_staged(counted(occurrences), "size-1")]
    single = found[0].select(F.col("items")[0].alias("item"))
    kept = _staged(held.join(single, "item", "left_semi").select("basket", "item"), "kept")
    for size in range(2, max_size + 1):
        known = occurrences.join(found[-1].select("items"), "items", "left_semi")
        longer = known.join(kept, "basket").filter(F.col("item") > F.element_at("items", -1))
        grown = longer.select("basket", F.concat("items", F.array("item")).alias("items"))
        for left_out in range(size - 1):
            # The set without its last item is frequent already; those without an earlier one are looked up.
            part = F.concat(F.slice("items", 1, left_out), F.slice("items", left_out + 2, size))
            if size > 2:
                known_part = found[-1].select(F.col("items").alias("part"))
                grown = grown.withColumn("part", part).join(known_part, "part", "left_semi").drop("part")
        occurrences = _staged(grown, f"grown-{size}")
        found.append(_staged(counted(occurrences), f"size-{size}"))
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.select("items", F.size("items").cast("long").alias("size"), "n", ratio("n", F.lit(total)).alias("support"))
