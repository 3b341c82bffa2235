"""Connected components of an edge list, by alternating large and small stars.

A round finds the least neighbour of every node and then takes one star: the large one joins the larger neighbours of a node to that
least one, the small one its smaller neighbours. The star whose turn it is is left out where it would change no edge, and the rounds end
as soon as neither would: a forest of links to one smaller node takes large stars only, each of which halves its depth. Each round is
written to the shared folder, and the driver sees two flags of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Per node u of the edges (u, v), u > v: the least m of itself and its neighbours; whether it has neighbours on both sides,
    and whether it has several smaller ones."""
    ends = F.array(F.struct("u", F.col("v").alias("w")), F.struct(F.col("v").alias("u"), F.col("u").alias("w")))
    both = edges.select(F.explode(ends).alias("end")).select("end.u", "end.w")
    smaller = F.when(F.col("w") < F.col("u"), F.col("w"))
    found = both.groupBy("u").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.max(smaller).alias("next"))
    deep, wide = (F.col("least") < F.col("u")) & (F.col("most") > F.col("u")), F.col("next").isNotNull() & (F.col("next") != F.col("least"))
    return stored(found.select("u", F.least("u", "least").alias("m"), deep.alias("deep"), wide.alias("wide")), "stars")


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the least node it is connected to) for every node of the edges (u, v)."""
    turned = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, large = stored(turned, "edges"), False
    while True:
        least = _least(now)
        deep, wide = least.agg(*(F.coalesce(F.max(c), F.lit(False)) for c in ("deep", "wide"))).first()
        if not deep and not wide:
            break
        large = deep and not (large and wide)
        if large:  # an edge (u, v) is one of the larger neighbours u of v
            joined = now.join(least.select(F.col("u").alias("v"), "m"), "v")
            now = stored(joined.select("u", F.col("m").alias("v")), "edges")
        else:
            joined = now.join(least.select("u", "m"), "u")
            ends = F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))
            small = joined.select(F.explode(ends).alias("end")).select("end.u", F.col("end.m").alias("v"))
            now = stored(small.filter("u != v").distinct(), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
