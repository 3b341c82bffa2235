"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts every text where it falls below a bound, so an insertion moves the cuts
near it and no others. Chunks are short, about 40 bytes: at its ends a passage loses a hash's width and part of a chunk, which for one
of fifty short words must leave well over `MIN_RUN` bytes. Chunks are compared by digest. The first place of a chunk, by (doc_id, text, position), stays. Every
other place is removed from its text if it lies in a run of such chunks of `MIN_RUN` bytes at least, or if the run is the
whole text: one or two chunks of a few words repeat by chance in clean prose, a passage repeats over several.

A 64-bit hash finds the chunks that may repeat; only those are compared by a second, independent 64-bit hash, so that rows are
short where there are many. Counts meet per chunk in the shuffle, summed before it; a chunk that fills a third of the
corpus arrives as one row per task.

Edge cases: a null text is empty, an empty text has no chunks; texts shorter than `LEAST` are one chunk; rows that repeat
both doc_id and text are one document and get the same result; a null doc_id comes after all others. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import by_value, map_arrow, stored, utf8

by_value(__name__)

LEAST, MEAN, MOST = 16, 24, 512  # bytes: shortest chunk, mean distance of cuts after it, longest chunk
MIN_REPEAT = 16  # shorter repeated chunks stay where they are
MIN_RUN = 100  # bytes of neighbouring repeated chunks that make a passage

GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 17) for i in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over the 16 bytes up to it (fewer at the start)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    places = (np.flatnonzero(gear(np.frombuffer(data, np.uint8)) < np.uint32((1 << 32) // MEAN)) + 1).tolist()
    out, at = [], 0
    for place in places:
        while place - at > MOST:
            at += MOST
            out.append(at)
        if place - at >= LEAST:
            out.append(place)
            at = place
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def passages(ends: list[int], repeated: list[int]) -> list[tuple[int, int]]:
    """Byte spans of the runs of repeated chunks (sorted numbers) that are long enough, or the whole text."""
    out: list[tuple[int, int]] = []
    for i in repeated:
        start = ends[i - 1] if i else 0
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], ends[i])
        else:
            out.append((start, ends[i]))
    return [(a, b) for a, b in out if b - a >= MIN_RUN or b - a == ends[-1]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chunk_rows(docs: DataFrame) -> DataFrame:
    """One row per chunk: doc_id, text_hash, seq, hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        ids = batch["doc_id"].to_pylist()
        out = {"doc_id": [], "text_hash": [], "seq": [], "hash": [], "check": []}
        for doc, h, data in zip(ids, batch["text_hash"].to_pylist(), utf8(batch["text"]), strict=True):
            at, seq = 0, 0
            for end in cuts(data):
                if end - at >= MIN_REPEAT:
                    piece = data[at:end]
                    whole = xxhash.xxh3_128_intdigest(piece)
                    out["hash"].append(_signed(whole & 0xFFFFFFFFFFFFFFFF))
                    out["check"].append(_signed(whole >> 64))
                    out["seq"].append(seq)
                    out["doc_id"].append(doc)
                    out["text_hash"].append(h)
                at, seq = end, seq + 1
        return out

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, f"doc_id {kind}, text_hash long, seq int, hash long, check long", run)


def place(doc_id: str = "doc_id") -> Column:
    """Sorts places of a chunk: by document, nulls last, then text and position."""
    return F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("doc_id"), "text_hash", "seq")


def removed_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the sorted numbers of the chunks that have an earlier place."""
    rows = chunk_rows(docs)
    often = stored(rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "chunks-often")
    # Repeated rows of one document are no repetition: they drop out below, where places are compared.
    found = stored(rows.join(often, "hash", "left_semi"), "chunks-found")
    first = found.groupBy("hash", "check").agg(F.min(place()).alias("first"), F.max(place()).alias("last"))
    first = stored(first.filter(F.col("first") != F.col("last")).drop("last"), "chunks-first")
    later = found.join(first, ["hash", "check"]).filter(place() != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("seq")).alias("removed"))


def dedupe_chunks(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_chunks, n_removed (bytes), n_spans (runs of removed chunks), kept_sha256, and the kept
    bytes if wanted."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    gone = removed_chunks(docs).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "kept binary, " if keep_text else ""

    def run(batch):
        names = ("n_bytes", "n_chunks", "n_removed", "n_spans", "kept", "kept_sha256")
        out = {"doc_id": batch["doc_id"], **{n: [] for n in names}}
        for data, removed in zip(utf8(batch["text"]), batch["removed"].to_pylist(), strict=True):
            ends = cuts(data)
            spans = passages(ends, removed or [])
            stays = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)], strict=True)
            pieces, n_spans = b"".join(data[a:b] for a, b in stays), len(spans)
            row = (len(data), len(ends), len(data) - len(pieces), n_spans, pieces, hashlib.sha256(pieces).hexdigest())
            for n, v in zip(names, row, strict=True):
                out[n].append(v)
        return out

    schema = f"doc_id {kind}, n_bytes long, n_chunks long, n_removed long, n_spans long, {kept}kept_sha256 string"
    return map_arrow(both.select("doc_id", "text", "removed"), schema, run)
