"""Sharding by a Feistel permutation over global row numbers: a shuffle that can be computed again for any row.

A row's number is its rank by the given order. An alternating Feistel network permutes the smallest power-of-two
range that holds all numbers; numbers that fall outside the table are permuted again until they fall inside (cycle
walking). Shard and slot are remainder and quotient of the permuted number, so shard sizes differ by one row at most.
All steps are column expressions.

Edge cases: nulls order first, as one value; rows equal in all ordering columns take neighbouring numbers, in any
order among themselves; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import free_name, stored

PRIME = 2_147_483_647
ROUNDS = 6
WALK = 96  # attempts after the first; each fails with a chance of at most one half


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an offset for each round."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append((int.from_bytes(d[:4], "big") % (PRIME - 1) + 1, int.from_bytes(d[4:8], "big") % PRIME))
    return out


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half: together the smallest power of two that is not below n."""
    bits = max(0, n - 1).bit_length()
    return bits // 2, bits - bits // 2


def permuted(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over the range that `widths` gives."""
    left, right = widths(n)
    masks = ((1 << left) - 1, (1 << right) - 1)
    keys = F.array(*[
        F.struct(F.lit(m).cast("long").alias("m"), F.lit(a).cast("long").alias("a"), F.lit(i % 2 == 0).alias("even"))
        for i, (m, a) in enumerate(round_keys(seed))
    ])
    start = F.struct(
        F.shiftright(x, right).alias("l"), x.bitwiseAND(F.lit(masks[1]).cast("long")).alias("r")
    )

    def mixed(v: Column, k: Column) -> Column:
        return (((v * k["m"] + k["a"]) % PRIME) * (v % 65521 + 1)) % PRIME

    def step(s: Column, k: Column) -> Column:
        l_next = s["l"].bitwiseXOR(mixed(s["r"], k)).bitwiseAND(F.lit(masks[0]).cast("long"))
        r_next = s["r"].bitwiseXOR(mixed(s["l"], k)).bitwiseAND(F.lit(masks[1]).cast("long"))
        return F.struct(
            F.when(k["even"], l_next).otherwise(s["l"]).alias("l"),
            F.when(k["even"], s["r"]).otherwise(r_next).alias("r"),
        )

    return F.aggregate(keys, start, step, lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]))


def walked(x: Column, n: int, seed: int) -> Column:
    """Permute until the number lies below n. Should a walk ever be longer than allowed, the job fails."""
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        permuted(x, n, seed),
        lambda s, _: F.when(s < n, s).otherwise(permuted(s, n, seed)),
    )
    return F.transform(F.array(end), lambda e: F.when(e < n, e).otherwise(
        F.raise_error(F.lit("cycle walk too long")).cast("long")))[0]


def numbered(df: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """Add each row's rank (from 0) by `order`, and tell how many rows there are.

    Rows are dealt by ranges of the order and sorted there; a place within the range plus the sizes of the ranges before
    gives the rank. Only one count per range meets in one task. Equal rows are spread by a tie number.
    """
    tie, at, part, before = (free_name(df, c) for c in ("_tie", "_at", "_part", "_before"))
    ordered = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col(tie))
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], tie)
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
    )
    placed = stored(ordered, "numbered").withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    sums = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias(before))
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, part).withColumn(name, F.col(before) + place).drop(part, at, before), total


def feistel_shards(df: DataFrame, shards: int, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Add `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard)."""
    if clash := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    row = free_name(df, "_row")
    rows, n = numbered(df, order, row)
    at = walked(F.col(row), n, seed)
    to = free_name(df, "_to")
    return (
        rows.withColumn(to, at)
        .withColumn("shard", (F.col(to) % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(to) / shards).cast("long") if n < (1 << 50) else F.expr(f"{to} div {shards}"))
        .drop(row, to)
    )


def locate(row: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""
    left, right = widths(n)
    keys = round_keys(seed)
    x = row
    while True:
        lo, hi = x & ((1 << right) - 1), x >> right
        for i, (m, a) in enumerate(keys):
            v = lo if i % 2 == 0 else hi
            f = (((v * m + a) % PRIME) * (v % 65521 + 1)) % PRIME
            if i % 2 == 0:
                hi = (hi ^ f) & ((1 << left) - 1)
            else:
                lo = (lo ^ f) & ((1 << right) - 1)
        x = hi << right | lo
        if x < n:
            return x % shards, x // shards
