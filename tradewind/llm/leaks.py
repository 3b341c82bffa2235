"""Benchmark decontamination: find documents that hold a benchmark item, up to a few edits.

Texts are compared as lower-case UTF-8 bytes with every run of ASCII characters that are no letter or digit as one space.
An item of m bytes may be changed by m // EDIT_SHARE edits. By the q-gram lemma a place that holds it within k edits shares at
least m - q + 1 - k q of its q-grams, and their diagonals (place in the document minus place in the item) lie within k
of each other. So shared q-grams are counted in overlapping bands of diagonals, bands that reach the bound are kept, and a banded
alignment settles them.

Items are sent to the executors in blocks of bounded size; every block is held against all documents.

Edge cases: a null text is empty and holds nothing; items that are null or shorter than `Q` bytes as compared are no
evidence and match nothing; repeated documents or items give repeated rows no more than once per (doc_id, item_id); a null
doc_id or item_id is reported as null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_schema, by_value, free_name, row_key, text_key

by_value(__name__)

Q = 8
EDIT_SHARE = 16  # one edit for so many bytes of an item
BLOCK_BYTES = 2_000_000  # of items that are sent at once

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[c for c in range(128) if not chr(c).isalnum()]] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def comparable(text: str | None) -> np.ndarray:
    raw = _CLEAN[np.frombuffer((text or "").lower().encode(), np.uint8)]
    space = raw == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = raw[keep]
    if len(out) and out[0] == 32:
        out = out[1:]
    return out[:-1] if len(out) and out[-1] == 32 else out


def grams(data: np.ndarray) -> np.ndarray:
    """Every 8 bytes in a row as one number."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    two = data[:-1] | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2] | two[2:].astype(np.uint32) << np.uint32(16)
    return four[:-4] | four[4:].astype(np.uint64) << np.uint64(32)


class Items:
    """The q-grams of a block of items, and what each item asks of a match."""

    def __init__(self, items: list[tuple[object, str]]):
        found = [(i, comparable(t)) for i, t in items]
        found = [(i, d) for i, d in found if len(d) >= Q]
        self.ids = [i for i, _ in found]
        self.data = [d for _, d in found]
        self.size = np.array([len(d) for d in self.data], np.int64)
        self.edits = self.size // EDIT_SHARE
        self.need = np.maximum(1, self.size - Q + 1 - self.edits * Q)
        every = [grams(d) for d in self.data]
        codes = np.concatenate(every) if every else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(every)), [len(g) for g in every])
        at = np.concatenate([np.arange(len(g)) for g in every]) if every else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.starts = np.unique(codes[order], return_index=True)
        self.starts = np.append(self.starts, len(codes))
        self.item, self.at = item[order], at[order]
        bits = max(10, int(len(self.codes) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[(self.codes * _MIX) >> self.shift] = True
        # Lengths in classes of a factor of two: (longest stretch, fewest shared grams) of each.
        classes = np.log2(self.size).astype(int) if len(found) else np.empty(0, int)
        self.classes = [
            (int((self.size + self.edits)[classes == c].max()), int(self.need[classes == c].min())) for c in np.unique(classes)
        ]

    def candidates(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first diagonal) of every band that shares enough q-grams with the item."""
        codes = grams(data)
        hits = np.flatnonzero(self.known[(codes * _MIX) >> self.shift])
        dense = np.zeros(len(hits) + 1, np.int32)
        for stretch, need in self.classes:
            if len(hits) >= need:
                first = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] < stretch)
                np.add.at(dense, first, 1)
                np.add.at(dense, first + need, -1)
        hits = hits[np.cumsum(dense[:-1]) > 0]
        if not len(hits):
            return
        slot = np.searchsorted(self.codes, codes[hits])
        slot[slot == len(self.codes)] = 0
        real = self.codes[slot] == codes[hits]
        hits, slot = hits[real], slot[real]
        counts = self.starts[slot + 1] - self.starts[slot]
        yield from self._bands(hits, slot, counts, len(data))

    def _bands(self, hits, slot, counts, n) -> Iterator[tuple[int, int]]:
        where = np.repeat(self.starts[slot] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        item = self.item[where]
        diagonal = np.repeat(hits, counts) - self.at[where]
        step = self.edits[item] + 1
        low = diagonal // step  # a band holds two steps, so every run of k + 1 diagonals lies whole in some band
        most = n + int(self.size.max()) + 2
        key = np.concatenate((item * (2 * most) + low + most, item * (2 * most) + low - 1 + most))
        key, number = np.unique(key, return_counts=True)
        which = key // (2 * most)
        good = number >= self.need[which]
        for i, band in zip(which[good].tolist(), (key[good] % (2 * most) - most).tolist(), strict=True):
            yield i, band * (int(self.edits[i]) + 1)

    def aligned(self, i: int, diagonal: int, data: np.ndarray) -> tuple[int, int] | None:
        """(edits, end) of the best match of item i on the 2 (k + 1) diagonals from the given one, widened by k on
        both sides; None if it needs more than k edits. Any place may be its start or end."""
        item, k = self.data[i], int(self.edits[i])
        m, low, width = len(item), diagonal - k, 4 * k + 2
        lo, hi = max(0, low), max(0, min(len(data), low + width + m))
        region = data[lo:hi].tobytes()
        if (at := region.find(item.tobytes())) >= 0:
            return 0, lo + at + m
        if not k:
            return None
        padded = np.full(width + m, 256, np.int16)
        padded[lo - low : lo - low + len(region)] = data[lo:hi]
        steps = np.arange(width)
        row = np.zeros(width, np.int32)
        # A start before the document or an end behind it would only pair item bytes with filling, at a cost of one each.
        for p in range(m):
            below = np.append(row[1:], m) + 1
            row = np.minimum(row + (padded[p : p + width] != item[p]), below)
            row = np.minimum.accumulate(row - steps) + steps
            if row.min() > k:
                return None
        best = int(row.argmin())
        return (int(row[best]), min(len(data), low + best + m)) if row[best] <= k else None

    def matches(self, data: np.ndarray) -> dict[int, tuple[int, int]]:
        """Item -> (edits, end) of its best match in the document."""
        out: dict[int, tuple[int, int]] = {}
        for i, diagonal in self.candidates(data):
            if out.get(i, (1, 0))[0] and (got := self.aligned(i, diagonal, data)) and got < out.get(i, (1 << 60, 0)):
                out[i] = got
        return out


def blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of BLOCK_BYTES at most (or one item); only one block is on the driver at a time."""
    block, size = [], 0
    for item in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        if block and size + len(item["text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item["item_id"], item["text"]))
        size += len(item["text"])
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each item that a document holds: doc_id, item_id, edits, end (byte behind the match, as compared)."""
    doc, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc}, item_id {item}, edits int, end int"
    arrow = arrow_schema(schema)
    texts, out = docs.select("doc_id", "text"), None
    for block in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            held = Items(sent.value)
            for batch in batches:
                rows = [
                    (d, held.ids[i], edits, end)
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for i, (edits, end) in held.matches(comparable(t)).items()
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        got = texts.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct("edits", "end")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.edits", "best.end")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, each judged by its own text: a doc_id may be null or repeated."""
    key, leaked = free_name(docs, "_row"), free_name(docs, "_leaked")
    rows = docs.withColumn(key, F.concat(text_key(), row_key()))
    bad = find_leaks(rows.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(leaked)).distinct()
    return rows.join(bad, F.col(key) == F.col(leaked), "left_anti").select(*docs.columns)
