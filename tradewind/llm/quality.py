"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through low-rank vectors; the sum over all pairs is computed in linear time from the
square of the sum and the sum of the squares. It is fitted on the driver on a bounded sample of labelled rows
(`SAMPLE`, the rows with the smallest hash of their id), featurised on the executors; scoring runs over all rows.

Edge cases: a null text is empty and gets a score like any other; a null character count counts as unknown; rows without a
label are not learnt from; a doc_id labelled more than once takes its lowest label; with one class or no label at all
the score is the smoothed share of label 1. Extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradewind.llm.common import by_value, free_name, map_arrow

by_value(__name__)

BUCKETS = 1 << 15
RANK = 8
SAMPLE = 6_000  # labelled rows at most that a model is fitted on
EPOCHS = 4  # passes over the sample, or more, until STEPS batches are done
STEPS = 300
THRESHOLD = 0.3

SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[]^_`{|}~", np.uint8)
MARKS = np.frombuffer(b"!\"'(),-.:;?", np.uint8)
STATISTICS = 15
KEEP_WORDS = 400_000


class WordBuckets(dict):
    """Word -> feature id, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        found = self[word] = STATISTICS + zlib.crc32(word.encode()) % BUCKETS
        return found


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    n, m = max(1, len(text)), max(1, len(words))
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(data.sum()))
    lines = text.split("\n")
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        n / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        pairs,
        data[65:91].sum() / size,
        data[48:58].sum() / size,
        data[SYMBOLS].sum() / size,
        data[MARKS].sum() / size,
        data[33] / size,
        data[128:].sum() / size,
        len(lines) / n * 100,
        len(set(lines)) / len(lines),
        0.0 if n_chars is None else np.log1p(max(0, n_chars)) - np.log1p(len(text)) + 1.0,
    ]


def features(text: str, n_chars: int | None, buckets: WordBuckets) -> tuple[list[int], list[float], list[float]]:
    """Word buckets with their weights (length 1 in sum of squares), and raw statistics."""
    words = text.split()
    counts = Counter(words)
    sums: dict[int, float] = {}
    for word, c in counts.items():
        b = buckets[word]
        sums[b] = sums.get(b, 0.0) + c
    ids = list(sums)
    weights = np.log1p(np.fromiter(sums.values(), np.float64, len(ids)))
    norm = float(np.sqrt((weights**2).sum())) or 1.0
    return ids, (weights / norm).tolist(), [float(x) for x in statistics(text, words, counts, n_chars)]


@dataclass
class Machine:
    """score = sigmoid(bias + sum w x + half the sum over ranks of (sum v x)^2 - sum (v x)^2)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, rows: list[tuple[list[int], list[float], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, values and row starts of several rows; every row holds all statistics, so none is empty."""
        z = np.clip((np.array([r[2] for r in rows]) - self.mean) / self.spread, -6, 6)
        sizes = np.array([STATISTICS + len(r[0]) for r in rows])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ids, values = np.empty(sizes.sum(), np.int64), np.empty(sizes.sum())
        for s, (i, w, _), stats in zip(starts, rows, z, strict=True):
            ids[s : s + STATISTICS] = np.arange(STATISTICS)
            values[s : s + STATISTICS] = stats
            ids[s + STATISTICS : s + STATISTICS + len(i)] = i
            values[s + STATISTICS : s + STATISTICS + len(i)] = w
        return ids, values, starts

    def sums(self, ids, values, starts) -> tuple[np.ndarray, np.ndarray]:
        """The value before the sigmoid, and the sum of v x per row and rank."""
        vx = self.factors[ids] * values[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = (total**2 - np.add.reduceat(vx**2, starts)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + pairs, total

    def score(self, rows) -> np.ndarray:
        if not rows:
            return np.empty(0)
        raw, _ = self.sums(*self.rows(rows))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[list[int], list[float], list[float]]], labels: list[int], seed: int = 7) -> Machine:
    """Adaptive gradient descent on the log loss, in small batches of a fixed random order."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    ones = sum(labels)
    stats = np.array([r[2] for r in rows]) if n else np.zeros((1, STATISTICS))
    size = STATISTICS + BUCKETS
    model = Machine(
        float(np.log((ones + 1) / (n - ones + 1))),
        np.zeros(size),
        rng.normal(0, 0.02, (size, RANK)),
        stats.mean(axis=0),
        np.maximum(stats.std(axis=0), 1e-6),
    )
    if ones in (0, n):
        model.factors[:] = 0
        return model
    y = np.array(labels, float)
    seen_bias, seen_linear, seen_factors = 1e-8, np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    rate, decay = 0.1, 1e-5
    for _ in range(max(EPOCHS, -(-STEPS * 128 // n))):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            chosen = order[at : at + 128]
            ids, values, starts = model.rows([rows[i] for i in chosen])
            raw, total = model.sums(ids, values, starts)
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]) / len(chosen)
            each = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(ids))))
            unique, where = np.unique(ids, return_inverse=True)
            g_linear = np.bincount(where, off[each] * values) + decay * model.linear[unique]
            own = model.factors[ids]
            inner = off[each][:, None] * values[:, None] * (total[each] - own * values[:, None])
            g_factors = np.stack([np.bincount(where, inner[:, f]) for f in range(RANK)], axis=1)
            g_factors += decay * model.factors[unique]
            seen_linear[unique] += g_linear**2
            seen_factors[unique] += g_factors**2
            model.linear[unique] -= rate * g_linear / np.sqrt(seen_linear[unique])
            model.factors[unique] -= rate / 4 * g_factors / np.sqrt(seen_factors[unique])
            g = off.sum()
            seen_bias += g * g
            model.bias -= rate * g / np.sqrt(seen_bias)
    return model


def id_hash(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from."""
    return id_hash(doc_id) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Machine:
    """A model fitted on at most SAMPLE labelled rows that are not held out."""
    chosen = (
        labels.filter(~held_out() & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(target).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    texts = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # SAMPLE rows of two numbers

    def run(batch):
        buckets = WordBuckets()
        got = [features(t or "", c, buckets) for t, c in zip(batch["text"].to_pylist(), batch["n_chars"].to_pylist(), strict=True)]
        columns = list(zip(*got, strict=True)) or [[], [], []]
        return {"y": batch["y"], "doc_id": batch["doc_id"], "ids": columns[0], "weights": columns[1], "stats": columns[2]}

    schema = "doc_id long, y int, ids array<int>, weights array<float>, stats array<double>"
    found = map_arrow(texts.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("y", F.col("y").cast("int")), schema, run)
    rows = found.dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([(r["ids"], r["weights"], r["stats"]) for r in rows], [r["y"] for r in rows])


def score_documents(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """All columns of `docs` and the score (0 to 1) as one more; metadata is read from `n_chars` where there is one."""
    if name in docs.columns:
        raise ValueError(f"the input already has a column {name}")
    chars = free_name(docs, "_chars")
    known = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # fixed size: BUCKETS x RANK numbers
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        model, buckets = Machine(**sent.value), WordBuckets()
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows = [features(t or "", c, buckets) for t, c in zip(columns["text"].to_pylist(), columns[chars].to_pylist(), strict=True)]
            scores = pa.array(model.score(rows), pa.float64())
            kept = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*kept[: len(arrow) - 1], scores], schema=arrow)

    return docs.withColumn(chars, known).mapInArrow(run, schema)
