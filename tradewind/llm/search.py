"""Ranked lexical search by reversed search: the items are indexed, the documents stream past the index.

Few items meet many documents, so the roles of a search engine are swapped. An inverted index over the items' terms (term ->
items that use it, with repeats) is broadcast. Every task streams its documents through it: the term counts of one document
touch only the items that share a term with it, and each item keeps a bounded heap of its best documents. The heaps of all
tasks are then merged by a window per item, first in parts, so that no task reads the heaps of all tasks of a busy item.

Items are taken in blocks. A block's index is read by the driver and broadcast, so its size is bounded: a block holds
BLOCK_BYTES of item text at most, or one item if that alone is longer (its distinct terms count then). Blocks run one after
the other, two passes over the documents each: document frequencies of the block's terms, then the scores. All arithmetic
after the logarithm is on integers, so the order of documents does not depend on how they were dealt out.

Edge cases. Null text has no term: such a document is never found, such an item finds nothing. Rows that share an item_id (nulls
too) are one item, their terms add up. Repeated document rows are ranked one by one; equal scores go by ascending doc_id, a
null doc_id last, so rows that tie in both are alike. Empty tables give no rows. Texts are read whole, other columns not at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tradewind.llm.common import arrow_schema, by_value, map_arrow, run_path, utf8

by_value(__name__)

TOP = 20
BLOCK_BYTES = 4 << 20
MERGE_PARTS = 32

# Every byte that ends a term, as a blank, and A-Z as a-z. Bytes from 0x80 on belong to terms, so UTF-8 needs no decoding.
BREAKS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERM_BYTES = bytes(32 if b in BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class ItemIndex:
    """Inverted index of one block: items of term i are `items[starts[i]:starts[i + 1]]`, with their repeats beside them."""

    def __init__(self, postings: list[tuple[int, bytes, int]], n_items: int):
        postings = sorted(postings, key=lambda p: p[1])
        self.n_items = n_items
        self.number: dict[bytes, int] = {}
        for _, term, _ in postings:
            self.number.setdefault(term, len(self.number))
        self.items = np.array([p[0] for p in postings], np.int64)
        self.repeats = np.array([p[2] for p in postings], np.int64)
        sizes = np.bincount([self.number[p[1]] for p in postings], minlength=len(self.number))
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Numbers of the block's terms that a document holds, with their counts."""
        number = self.number
        return [(number[w], tf) for w, tf in Counter(words).items() if w in number]

    def scores(self, hits: list[tuple[int, int]], weights: np.ndarray, m: int) -> np.ndarray:
        """One document's score for every item of the block."""
        found, tf = np.array(hits, np.int64).T
        gain = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        first, sizes = self.starts[found], self.starts[found + 1] - self.starts[found]
        at = np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.items[at], np.repeat(gain, sizes) * self.repeats[at])
        return out


class Heaps:
    """The best documents of every item seen so far; an entry is (score, -doc_id), a null doc_id below every other."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.heaps: list[list] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a score below this cannot enter

    def offer(self, doc_id: int | None, scores: np.ndarray) -> None:
        key = -math.inf if doc_id is None else -doc_id
        for item in np.flatnonzero(scores >= self.least).tolist():
            heap, entry = self.heaps[item], (int(scores[item]), key)
            if len(heap) < self.top:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, key in heap:
                yield item, None if key == -math.inf else -key, score


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats): how often each item uses each of its terms."""

    def run(batch: dict) -> dict:
        out: dict[str, list] = {"item_id": [], "term": [], "repeats": []}
        for item, text in zip(batch["item_id"].to_pylist(), utf8(batch["text"]), strict=True):
            for term, n in Counter(terms_of(text)).items():
                out["item_id"].append(item)
                out["term"].append(term)
                out["repeats"].append(n)
        return out

    kind = items.schema["item_id"].dataType.simpleString()
    each = map_arrow(items.select("item_id", "text"), f"item_id {kind}, term binary, repeats long", run)
    return each.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def item_blocks(items: DataFrame, block_bytes: int) -> DataFrame:
    """`items` with a number `block`. Blocks are halved until each is small enough or holds one item."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    slim = items.select("item_id", "text")
    total = slim.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while True:
        blocks = slim.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        per_item = blocks.groupBy("block", "item_id").agg(F.sum(size).alias("bytes"))
        crowded = per_item.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"))
        if crowded.filter((F.col("bytes") > block_bytes) & (F.col("items") > 1)).isEmpty():
            return blocks
        n *= 2


def frequencies(docs: DataFrame, index) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the documents that hold each term of the block (broadcast `index`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        df = np.zeros(len(known.number) + 2, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                words = terms_of(text)
                if words:
                    df[-2] += 1
                    df[-1] += len(words)
                    df[[i for i, _ in known.hits(words)]] += 1
        used = np.flatnonzero(df)
        number = np.where(used >= len(known.number), used - len(df), used)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(df[used])], names=["number", "n"])

    rows = docs.select("text").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n")).collect()
    counts = dict(map(tuple, rows))
    return counts.pop(-2, 0), counts.pop(-1, 0), counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def task_heaps(docs: DataFrame, index, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score) of every task's heaps."""
    schema = T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = index.value, weights.value
        heaps = Heaps(known.n_items, top)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = terms_of(text)
                hits = known.hits(words)
                if hits:
                    m = 100 - 25 + (25 * len(words) * n_docs) // n_terms
                    heaps.offer(doc_id, known.scores(hits, w, m))
        columns = zip(*heaps.rows(), strict=True) if any(heaps.heaps) else ([], [], [])
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best(heaps: DataFrame, top: int) -> DataFrame:
    """The heaps of all tasks merged: parts of an item's entries first, then what is left of them."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    cut = heaps.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    left = cut.filter(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's `top` best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    blocks = item_blocks(items, block_bytes)
    path = run_path(spark, "search")
    schema = T.StructType(
        [
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    spark.createDataFrame([], schema).write.parquet(path)
    for block in sorted(r[0] for r in blocks.select("block").distinct().collect()):
        rows = item_terms(blocks.filter(F.col("block") == block)).collect()
        names = list(dict.fromkeys(r[0] for r in rows))
        place = {name: i for i, name in enumerate(names)}
        built = ItemIndex([(place[i], bytes(term), n) for i, term, n in rows], len(names))
        index = spark.sparkContext.broadcast(built)
        n_docs, n_terms, df = frequencies(docs, index)
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, df.get(i, 0)) for i in range(len(built.number))], np.int64))
        found = best(task_heaps(docs, index, weights, n_docs, n_terms, top), top)
        named = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("item", T.LongType()), schema["item_id"]]))
        found.join(named, "item").select(schema.names).write.mode("append").parquet(path)
        index.destroy()
        weights.destroy()
    return spark.read.schema(schema).parquet(path)
