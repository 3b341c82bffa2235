"""What each filter of a chain removes under every order, from one word per document.

Five filters give 32 subsets. A document's failures (five bits) become a 32-bit truth table: bit S is set if the document
survives all filters of subset S. Counting each bit position over all words of a part gives the survivors of every subset at
once, and any order of filters is a walk through subsets: what a step removes is the difference of two survivor counts. The
positional counts are taken with carry-save adders: three words become a sum word and a carry word, level by level, until two
words of each weight are left, so that 32 counters advance by a few bitwise operations on whole arrays.

The text is read once, by column expressions, into one narrow row per document (digest, failures), which is stored. A text's least
doc_id is a minimum per digest that is combined before the shuffle, and a document is compared with it by digest and doc_id
together, so copies of one text spread over all tasks. Parts are counters too: a part with most of the rows sends one row a task.

Edge cases. Null text is empty; null lang is the part "". Texts are compared by their SHA-256. A null doc_id is neither smaller
nor larger than another: such a row never fails E, makes no other row fail it, and has no labels. Rows that repeat a doc_id and
text are counted each and do not fail E through one another. Rows of `labels` that share a doc_id count as 1 if one of them is 1.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_schema, by_value, numbers, stored, text_key

by_value(__name__)

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
KEEP_WORDS = 1 << 16  # words held back per task before they are counted
KEEP_PARTS = 10_000  # counters held per task

# Fixed values of the audit: limits in the failure conditions.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
ODD_CHARACTERS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"

COUNTERS = ("everyone", "good", "toxic")
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """For each of the 32 bit positions, how many of `words` have the bit set."""
    counts = np.zeros(32, np.int64)
    positions = np.arange(32, dtype=np.uint32)
    weight = 1
    while words.size:
        carries = [np.empty(0, np.uint32)]
        while (third := words.size // 3) > 0:
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * third :]])
        counts += weight * (words[:, None] >> positions & np.uint32(1)).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries)
        weight *= 2
    return counts


class PartCounts:
    """Positional counts per part and counter, with words held back until a block is full."""

    def __init__(self):
        self.counts: dict[str, np.ndarray] = {}
        self.words: dict[str, list] = {}
        self.held = 0

    def add(self, part: str, words: np.ndarray, marks: list[np.ndarray]) -> None:
        self.words.setdefault(part, []).append([words[m] for m in marks])
        self.held += words.size
        if self.held >= KEEP_WORDS:
            self.settle()

    def settle(self) -> None:
        for part, kept in self.words.items():
            total = self.counts.setdefault(part, np.zeros((len(COUNTERS), SUBSETS), np.int64))
            for k, columns in enumerate(zip(*kept, strict=True)):
                total[k] += positional_counts(np.concatenate(columns))
        self.words, self.held = {}, 0

    def rows(self) -> dict[str, list]:
        self.settle()
        out = {"part": list(self.counts)}
        out |= {name: [c[k].tolist() for c in self.counts.values()] for k, name in enumerate(COUNTERS)}
        self.counts = {}
        return out


def failures(text: Column) -> list[Column]:
    """Conditions A to D on a text, as bits."""
    words = F.array_remove(F.split(text, BLANKS, -1), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    conditions = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(ODD_CHARACTERS),
    ]
    return [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]


def judged(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, part, digest of the text, failures of A to D as bits."""
    text = F.coalesce("text", F.lit(""))
    bits = failures(text)
    return docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_key("text").alias("digest"), sum(bits[1:], bits[0]).alias("fails")
    )


def failing(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (A to E), good, toxic of every document."""
    known, unknown = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    least = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]
    )
    last = 1 << (len(FILTERS) - 1)
    compared = known.join(least, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("fails") + F.when(F.col("first"), 0).otherwise(last)).alias("fails")
    )
    no = F.lit(False)
    labelled = compared.join(marks, "doc_id", "left").select(
        "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )
    return labelled.unionByName(unknown.select("part", "fails", no.alias("good"), no.alias("toxic")))


def survivors(rows: DataFrame) -> DataFrame:
    """part and, for each counter, an array with the survivors of every subset of filters."""
    schema = "part string, " + ", ".join(f"{c} array<long>" for c in COUNTERS)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = PartCounts()
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            words = WORDS[numbers(columns["fails"])]
            good, toxic = (numbers(columns[c]).astype(bool) for c in ("good", "toxic"))
            parts = columns["part"].dictionary_encode()
            codes = numbers(parts.indices)
            for code, part in enumerate(parts.dictionary.to_pylist()):
                own = codes == code
                tally.add(part, words[own], [slice(None), good[own], toxic[own]])
            if len(tally.counts) + len(tally.words) > KEEP_PARTS:
                yield pa.RecordBatch.from_pydict(tally.rows(), schema=arrow)
        yield pa.RecordBatch.from_pydict(tally.rows(), schema=arrow)

    each = rows.mapInArrow(run, schema)
    sums = [F.sum(F.col(c)[s]).alias(f"{c}_{s}") for c in COUNTERS for s in range(SUBSETS)]
    total = each.groupBy("part").agg(*sums)
    return total.select("part", *[F.array(*[F.col(f"{c}_{s}") for s in range(SUBSETS)]).alias(c) for c in COUNTERS])


def all_orders_removed(bit: int) -> Column:
    """What the filter `bit` removes, summed over all orders: a subset comes just before it in |S|! (4 - |S|)! of them."""
    out = F.lit(0).cast("long")
    for s in range(SUBSETS):
        if not s & bit:
            before = s.bit_count()
            ways = factorial(before) * factorial(len(FILTERS) - 1 - before)
            out = out + ways * (F.col("everyone")[s] - F.col("everyone")[s | bit])
    return out


def walk(total: DataFrame) -> DataFrame:
    """Every order and step of every part, from the survivors of subsets alone."""
    steps = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append({"filter_order": order, "step": step, "before": before, "after": before | bit, "bit": bit})
            before |= bit
    kind = "array<struct<filter_order string, step int, before int, after int, bit int>>"
    bits = [1 << i for i in range(len(FILTERS))]
    shares = F.map_from_arrays(F.array(*map(F.lit, bits)), F.array(*map(all_orders_removed, bits)))
    wide = total.select("*", shares.alias("shares")).select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    survive = lambda name, subset: F.col(name)[subset]
    everything = F.lit(SUBSETS - 1)
    fails = survive("everyone", F.lit(0)) - survive("everyone", F.col("bit"))
    lost = {c: survive(c, F.col("before")) - survive(c, F.col("after")) for c in COUNTERS}
    return wide.select(
        "part",
        "filter_order",
        "step",
        survive("everyone", F.col("after")).alias("kept"),
        lost["everyone"].alias("removed"),
        (fails - lost["everyone"]).alias("redundant"),
        (survive("everyone", everything - F.col("bit")) - survive("everyone", everything)).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.col("shares")[F.col("bit")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return walk(survivors(failing(stored(judged(docs), "audit"), labels)))
