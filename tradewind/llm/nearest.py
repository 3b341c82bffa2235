"""Nearest neighbours by cosine: inverted lists with an adaptive scan of dimensions.

Unit vectors are put into the list of their nearest centre. A query probes the nearest lists. Within a list the vectors are turned
by a random rotation and read in blocks of columns: from the distance over the first d of D dimensions a hypothesis
test decides whether the full distance can still be among the k smallest; candidates that fail it are abandoned. What
survives is scored exactly, in double precision, on the original vectors.

The centres come from a bounded sample (`SAMPLE_NUMBERS`); every vector is indexed. Lists and the queries that probe
them are cut into blocks of bounded size, so one very full list is scanned by many tasks, and no limit drops a row.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without a vec_id
and rows whose number of components is not the most common one (ties: the larger); of rows that repeat a vec_id the one with
the least vector counts; equal scores go to the smaller vec_id; with fewer than k candidates all are returned; no usable
vector, no result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_schema, by_value, map_arrow, stored

by_value(__name__)

SAMPLE_NUMBERS = 2_000_000  # components of the vectors that centres are fitted on
MOST_LISTS = 1024
PROBED = 0.75  # share of the lists that a query visits
COLUMNS = 16  # dimensions of one block
SLACK = 2.5  # of the hypothesis test: larger abandons later
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    chosen = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = (sample @ chosen.T).argmax(axis=1)
        for c in range(len(chosen)):
            members = sample[own == c]
            if len(members) and (length := np.linalg.norm(total := members.sum(axis=0))) > 1e-9:
                chosen[c] = total / length
    return chosen


def closest(
    query: np.ndarray, turned_query: np.ndarray, rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, own: int, k: int
) -> list[tuple[float, int]]:
    """The k best (score, id) of a block for one query."""
    n, size = turned.shape
    alive = np.flatnonzero(ids != own)
    if not len(alive):
        return []
    best: list[tuple[float, int]] = []
    # The first rows are measured whole; they give the distance that others must beat.
    first, rest = alive[: 4 * k], alive[4 * k :]
    bound = np.inf
    for chosen in (first, rest):
        partial = np.zeros(len(chosen))
        for at in range(0, size, COLUMNS):
            if not len(chosen):
                break
            part = turned[chosen, at : at + COLUMNS] - turned_query[at : at + COLUMNS]
            partial += np.einsum("ij,ij->i", part, part)
            seen = min(size, at + COLUMNS)
            if np.isfinite(bound) and seen < size:
                keep = partial * (size / seen) <= bound * (1 + SLACK / np.sqrt(seen)) ** 2 + 1e-9
                chosen, partial = chosen[keep], partial[keep]
        if len(chosen):
            if np.isfinite(bound):
                near = partial <= bound + 1e-9
                chosen, partial = chosen[near], partial[near]
            scores = np.einsum("ij,j->i", rows[chosen], query)
            best += list(zip((-scores).tolist(), ids[chosen].tolist(), strict=True))
            best = sorted(best)[:k]
            if len(best) == k:
                bound = max(0.0, 2 + 2 * best[-1][0])
    return [(-s, i) for s, i in best]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding") -> DataFrame:
    """For each vec_id divisible by `every` its k nearest others: query_id, rank, vec_id, score."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    good = good.filter(F.col("vec_id").isNotNull() & usable("vec"))
    sizes = good.groupBy(F.size("vec").alias("size")).agg(F.countDistinct("vec_id").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size, n = common["size"], common["n"]
    good = good.filter(F.size("vec") == size).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(256, SAMPLE_NUMBERS // size)).toArrow()
    lists = max(1, min(MOST_LISTS, int(np.sqrt(n) / 2), len(sample) // 32))
    middle = centres(unit(matrix(sample["vec"].combine_chunks())), lists)
    turn = rotation(size)
    sent = spark.sparkContext.broadcast((middle, turn))  # MOST_LISTS x size and size x size numbers
    probed = max(1, int(np.ceil(len(middle) * PROBED)))

    def assign(batch):
        if not len(batch["vec_id"]):
            return {"list": [], "probes": [], **batch}
        near = unit(matrix(batch["vec"])) @ sent.value[0].T
        ids = batch["vec_id"].to_numpy()
        order = np.argsort(-near, axis=1, kind="stable")[:, :probed]
        probes = [o.tolist() if i % every == 0 else None for i, o in zip(ids.tolist(), order, strict=True)]
        return {"list": order[:, 0], "probes": probes, **batch}

    element = good.schema["vec"].dataType.simpleString()
    placed = stored(map_arrow(good, f"list int, vec_id long, vec {element}, probes array<int>", assign), "ann-lists")
    asked = placed.filter("probes is not null").select(F.explode("probes").alias("list"), "vec_id", "vec")

    def blocks(df: DataFrame, name: str, most: int) -> dict[int, int]:
        """Number of blocks of each list that needs more than one; there are MOST_LISTS lists at most."""
        return {r["list"]: -(-r["n"] // most) for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}

    row_blocks, query_blocks = blocks(placed, "row", BLOCK_ROWS), blocks(asked, "query", BLOCK_QUERIES)
    counts = spark.createDataFrame(
        [(c, b, query_blocks[c]) for c, b in row_blocks.items() if c in query_blocks] or [],
        "list int, row_blocks int, query_blocks int",
    )
    spread = F.xxhash64("vec_id", F.lit(3))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its block, once for every block of the other side."""
        return (
            df.join(F.broadcast(counts), "list")
            .withColumn(own, F.pmod(spread, F.col(f"{own}s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .select("list", "row_block", "query_block", "vec_id", "vec")
        )

    rows = dealt(placed.select("list", "vec_id", "vec"), "row_block", "query_block")
    queries = dealt(asked, "query_block", "row_block").toDF("q_list", "q_row_block", "q_query_block", "query_id", "query")
    found = arrow_schema("query_id long, vec_id long, score double")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, q = matrix(left["vec"].combine_chunks()), matrix(right["query"].combine_chunks())
            x, q = unit(x), unit(q)
            turned, turned_q = x @ sent.value[1], q @ sent.value[1]
            ids = left["vec_id"].to_numpy()
            for i, own in enumerate(right["query_id"].to_pylist()):
                out += [(own, j, s) for s, j in closest(q[i], turned_q[i], x, turned, ids, own, k)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, found, strict=True)], schema=found)

    key = ["list", "row_block", "query_block"]
    pairs = rows.groupBy(*key).cogroup(queries.groupBy(*[f"q_{c}" for c in key]))
    hits = pairs.applyInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
