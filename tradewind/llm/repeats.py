"""Repeated byte strings, by prefix-free parsing.

A rolling hash over `TRIGGER` bytes places triggers: in every string of `LENGTH` bytes the leftmost least hash is one, so
every such string holds a trigger, and equal strings hold it at the same place. Consecutive strings with the same
trigger make one phrase (the bytes that they cover); phrases overlap by `LENGTH` - 1 bytes. The parse lists the phrases of all
documents as (trigger, digest, position); the dictionary holds each distinct phrase once, so a passage that recurs a million times is
looked at once.

Phrases whose trigger occurs once in the corpus hold no repeated string. A phrase that occurs twice repeats whole. For the
rest, the distinct phrases that share a trigger are laid out together and a suffix array over them, by prefix
doubling up to LENGTH bytes, puts equal strings next to each other. Only strings with the same trigger can be equal, so the suffix
arrays of the blocks together order all candidate suffixes of the corpus, and each phrase's answer is carried back through
the parse to its positions.

A trigger with more than `HOT` distinct phrases is not laid out in one block: its strings are counted by a 128-bit digest across all
tasks instead. Counts are summed before shuffles, and only documents with repeated triggers have their texts moved.

Edge cases: a null text is empty; texts shorter than LENGTH keep everything; a repeated row counts as another place, so all of
it that is LENGTH long goes; documents that share doc_id but not text are told apart by the text's hash; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_schema, by_value, map_arrow, stored, utf8

by_value(__name__)

LENGTH = 200
TRIGGER = 32
PLACES = LENGTH - TRIGGER + 1  # of a trigger in a string
HOT = 4096  # distinct phrases of one trigger that are laid out together at most
BLOCK_BYTES = 2_000_000  # of phrases in one suffix array (or one trigger's, if they are more)

_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i]), 23) for i in range(256)], np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the TRIGGER bytes from each place on, by doubling."""
    h, base = _BYTE[data], 0x9E3779B97F4A7C15
    step = 1
    while step < TRIGGER:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, trigger hash) of each phrase; string i covers bytes i to i + LENGTH."""
    if len(data) < LENGTH:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64)
    h = rolling(data)
    least, covered = h, 1
    while covered * 2 <= PLACES:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    rest = PLACES - covered
    least = np.minimum(least[: len(least) - rest], least[rest:])
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(least))), least[starts]


def string_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the LENGTH bytes from each place on among all places: a suffix array cut at that depth, in its inverse
    form. Equal strings have equal ranks, and ranks follow the order of the bytes."""
    size = len(data) - LENGTH + 1
    codes = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        codes = codes << np.uint64(8) | data[i : len(data) - 7 + i]
    rank, depth = np.unique(codes, return_inverse=True)[1], 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        pair = rank[: len(rank) - step].astype(np.int64) * (len(rank) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        depth += step
    return rank[:size]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parse(docs: DataFrame) -> DataFrame:
    """The parse of all texts: doc_id, text_hash, start, strings, trigger, phrase (digest)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        columns = {c: [] for c in ("doc_id", "text_hash", "start", "strings", "trigger", "phrase")}
        for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), utf8(batch["text"]), strict=True):
            starts, strings, triggers = phrases(np.frombuffer(text, np.uint8))
            if not len(starts):
                continue
            ends = (starts + strings + (LENGTH - 1)).tolist()
            digests = [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(starts.tolist(), ends, strict=True)]
            columns["doc_id"] += [doc] * len(starts)
            columns["text_hash"] += [key] * len(starts)
            columns["start"].append(starts)
            columns["strings"].append(strings)
            columns["trigger"].append(signed(triggers))
            columns["phrase"].append(signed(np.array(digests, np.uint64)))
        for c in ("start", "strings", "trigger", "phrase"):
            columns[c] = np.concatenate(columns[c]) if columns[c] else []
        return columns

    schema = f"doc_id {kind}, text_hash long, start int, strings int, trigger long, phrase long"
    return map_arrow(docs.select("doc_id", "text_hash", "text"), schema, run)


def runs_of(flags: np.ndarray) -> list[dict]:
    """Stretches of true values as {from, to}."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()]


RANGES = "trigger long, phrase long, ranges array<struct<from: int, to: int>>"


def repeated_in_blocks(dictionary: DataFrame) -> DataFrame:
    """Which strings of each phrase another phrase holds too, for whole triggers laid out together."""
    schema = arrow_schema(RANGES)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        out = [[], [], []]
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        ranks = string_ranks(data)
        at = np.cumsum([0, *(len(r[3]) for r in rows)])
        counts = [len(r[3]) - LENGTH + 1 for r in rows]
        places = np.concatenate([np.arange(a, a + c) for a, c in zip(at[:-1].tolist(), counts, strict=True)])
        found = ranks[places]
        often = (np.bincount(found) > 1)[found]
        for (trigger, phrase, whole, _), flags in zip(rows, np.split(often, np.cumsum(counts)[:-1]), strict=True):
            if not whole and flags.any():
                out[0].append(trigger)
                out[1].append(phrase)
                out[2].append(runs_of(flags))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield block(rows)

    dealt = dictionary.repartition("trigger").sortWithinPartitions("trigger", "phrase")
    return dealt.select("trigger", "phrase", "whole", "bytes").mapInArrow(run, RANGES)


def repeated_by_digest(dictionary: DataFrame) -> DataFrame:
    """The same by counting the strings of all phrases."""

    def run(batch):
        out = {c: [] for c in ("trigger", "phrase", "whole", "place", "a", "b")}
        for trigger, phrase, whole, data in zip(
            *(batch[c].to_pylist() for c in ("trigger", "phrase", "whole", "bytes")), strict=True
        ):
            for i in range(len(data) - LENGTH + 1):
                d = xxhash.xxh3_128_digest(data[i : i + LENGTH])
                row = (trigger, phrase, whole, i, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True))
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
        return out

    schema = "trigger long, phrase long, whole boolean, place int, a long, b long"
    strings = stored(map_arrow(dictionary.select("trigger", "phrase", "whole", "bytes"), schema, run), "repeats-strings")
    often = stored(strings.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "repeats-digests")
    found = strings.filter("NOT whole").join(often, ["a", "b"], "left_semi")
    one = F.struct(F.col("place").alias("from"), (F.col("place") + 1).alias("to"))
    return found.groupBy("trigger", "phrase").agg(F.collect_list(one).alias("ranges"))


def repeated_strings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From docs with text_hash: the documents that may repeat something, with their texts; and the covered bytes
    (doc_id, text_hash, spans)."""
    listed = parse(docs)
    often = stored(listed.groupBy("trigger").agg(F.count("*").alias("n")).filter("n > 1").select("trigger"), "repeats-triggers")
    places = stored(listed.join(often, "trigger", "left_semi"), "repeats-parse")
    at = F.struct("doc_id", "text_hash", "start", "strings")
    distinct = stored(
        places.groupBy("trigger", "phrase").agg((F.count("*") > 1).alias("whole"), F.min(at).alias("at")), "repeats-phrases"
    )
    triggers = stored(distinct.groupBy("trigger").agg(F.count("*").alias("n")).filter("n > 1"), "repeats-mixed")
    named = places.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    texts = stored(docs.join(named, same, "left_semi"), "repeats-texts")

    # The dictionary: bytes of the distinct phrases that share a trigger with others.
    wanted = distinct.join(triggers, "trigger").select("trigger", "phrase", "whole", "n", "at.*")
    lists = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_list(F.struct("trigger", "phrase", "whole", "n", "start", "strings")).alias("wanted")
    )

    def run(batch):
        out = {c: [] for c in ("trigger", "phrase", "whole", "n", "bytes")}
        for data, rows in zip(utf8(batch["text"]), batch["wanted"].to_pylist(), strict=True):
            for r in rows:
                for c in ("trigger", "phrase", "whole", "n"):
                    out[c].append(r[c])
                out["bytes"].append(data[r["start"] : r["start"] + r["strings"] + LENGTH - 1])
        return out

    both = texts.dropDuplicates(["doc_id", "text_hash"]).join(lists, same).select("text", "wanted")
    schema = "trigger long, phrase long, whole boolean, n long, bytes binary"
    dictionary = stored(map_arrow(both, schema, run), "repeats-dictionary")
    parts = repeated_in_blocks(dictionary.filter(F.col("n") <= HOT))
    hot = dictionary.filter(F.col("n") > HOT)
    if not hot.isEmpty():
        parts = parts.unionByName(repeated_by_digest(hot))
    whole = distinct.filter("whole").select(
        "trigger", "phrase", F.array(F.struct(F.lit(0).alias("from"), F.col("at.strings").alias("to"))).alias("ranges")
    )
    known = stored(parts.unionByName(whole), "repeats-known")
    spans = places.join(known, ["trigger", "phrase"]).select("doc_id", "text_hash", "start", F.explode("ranges").alias("r"))
    covered = F.struct(
        (F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to") + (LENGTH - 1)).alias("to")
    )
    return texts, spans.groupBy("doc_id", "text_hash").agg(F.collect_set(covered).alias("spans"))


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; the kept bytes (null: all) if wanted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    texts, spans = repeated_strings(rows)
    spans = spans.toDF("_doc", "_hash", "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        out = {c: [] for c in ("kept", "left", "n_spans")} | {"_doc": batch["doc_id"], "_hash": batch["text_hash"], "sha": []}
        for data, found in zip(utf8(batch["text"]), batch["spans"].to_pylist(), strict=True):
            pieces, at, n = [], 0, 0
            for a, b in sorted((s["from"], s["to"]) for s in found):
                if a > at or not n:
                    pieces.append(data[at:a])
                    n += 1
                at = max(at, b)
            pieces.append(data[at:])
            kept = b"".join(pieces)
            out["kept"].append(kept if keep_text else None)
            out["left"].append(len(kept))
            out["n_spans"].append(n)
            out["sha"].append(hashlib.sha256(kept).hexdigest())
        return out

    schema = f"_doc {kind}, _hash long, kept binary, left long, n_spans long, sha string"
    one = texts.dropDuplicates(["doc_id", "text_hash"]).join(spans, same)
    changed = stored(map_arrow(one.select("doc_id", "text_hash", "text", "spans"), schema, run), "repeats-changed")
    whole = rows.select(
        "doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")
    )
    both = whole.join(changed, same, "left")
    columns = [
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "sha256").alias("kept_sha256"),
    ]
    return both.select(*columns, *(["kept"] if keep_text else []))
