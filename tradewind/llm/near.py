"""Near duplicates by order MinHash, verified by banded alignment.

A text is its lower-case words. Its k-mers are all runs of five words, each labelled with how often it came before in the text. Every
one of `SKETCHES` random orders of the labelled k-mers picks the `PICKED` least, and the sketch is those k-mers in their text order,
so two texts share a sketch when they hold the same picks in the same order. Texts that share a sketch are candidates;
they are near duplicates if an alignment of their words needs at most a fifth of the longer one's words as edits. Classes are the
connected components of these links; exact copies are one text from the start.

A bucket is the texts with one sketch in common. Every text is first compared with one other only: of the least texts of its
buckets, the one it shares most buckets with; so a large group of copies makes a star, not all pairs. Buckets that still hold
several classes after that are compared through in blocks of bounded size. A block holds its texts and the classes known so far, aligns
the pairs that are in two classes, joins classes as it goes, and puts out a star of each set of classes that it joined: fewer links than
it has texts, all between the least texts of known classes, so that what is joined last is a small graph of little depth.
The largest class of a bucket never meets itself. A pair is aligned in the first bucket that it shares, or it is in one class by then,
or it is refuted by proof: lengths and counts of words in `BINS` groups bound the edits from below.

Edge cases: null counts as an empty text; texts without words form classes of exact copies; shorter texts than five words are one
k-mer; rows that repeat both doc_id and text are copies; a class is named by its least doc_id, null if it has none.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import arrow_schema, by_value, free_name, map_arrow, stored, text_key, worker_memory
from tradewind.llm.components import components

by_value(__name__)

WORDS = 5
SKETCHES = 32
PICKED = 2
SIMILARITY = 0.8
BINS = 256  # groups of words whose counts a profile holds
BLOCK = 2048  # texts of a bucket that are compared with another block at once: about a second's work for a few MB that are moved
BLOCK_BYTES = 8 << 20  # and about so many bytes of text

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([xxhash.xxh64_intdigest(struct.pack("<q", j), 99) for j in range(SKETCHES)], np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return found


def known_words() -> WordHashes:
    """What this worker remembers from one batch to the next."""
    return worker_memory("near").setdefault("words", WordHashes())


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hash of every run of five words, labelled by its occurrence."""
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, 7, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = mix(out) + words[i : i + n] if len(words) >= WORDS else mix(out) + words[i]
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - first).astype(np.uint64)
    return mix(out + occurrence * np.uint64(0xD6E8FEB86659FD93))


def sketches(words: np.ndarray) -> np.ndarray:
    """One number for each sketch."""
    found = kmers(words)
    out = np.empty(SKETCHES, np.uint64)
    step = SKETCHES if len(found) < 20_000 else 1
    for at in range(0, SKETCHES, step):
        values = mix(found[None, :] ^ _SEEDS[at : at + step, None])
        if values.shape[1] > PICKED:
            picked = np.argpartition(values, PICKED - 1, axis=1)[:, :PICKED]
        else:
            picked = np.tile(np.arange(values.shape[1]), (len(values), 1))
        picked.sort(axis=1)
        code = np.zeros(len(values), np.uint64)
        for c in range(picked.shape[1]):
            code = mix(code + found[picked[:, c]])
        out[at : at + step] = code
    return out


def bins(words: np.ndarray) -> np.ndarray:
    """How many words fall in each bin; bounds the edits between two texts from below."""
    found = np.bincount((words >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS)
    return np.minimum(found, 255).astype(np.int16)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most `most`, by alignment in a band that doubles."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    same = a == b[: len(a)]
    start = len(a) if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    if len(a):
        same = a[::-1] == b[::-1][: len(a)]
        end = len(a) if same.all() else int(same.argmin())
        a, b = a[: len(a) - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if not n:
        return m if m <= most else None
    # Words that one side has and the other lacks must be edited.
    values, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    counts = np.bincount(where[:n], minlength=len(values)) - np.bincount(where[n:], minlength=len(values))
    if max(counts[counts > 0].sum(), -counts[counts < 0].sum()) > most:
        return None
    if n > 1000 and m - n <= 4 < most and (got := _furthest(a, b, 4)) is not None:
        return got
    band = max(64, m - n)
    while True:
        band = min(band, most)
        got = _banded(a, b, band)
        if got is not None or band == most:
            return got
        band *= 2


def _furthest(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Furthest place on every diagonal with 0, 1, 2, ... edits; equal stretches are looked up, not walked."""
    n, m = len(a), len(b)
    ends = []
    for d in range(-most, most + 1):
        lo, hi = max(0, -d), min(n, m - d)
        stop = np.arange(n + 2)
        if hi > lo:
            differs = np.where(a[lo:hi] != b[lo + d : hi + d], np.arange(lo, hi), hi)
            stop[lo:hi] = np.minimum.accumulate(differs[::-1])[::-1]
        ends.append(stop.tolist())
    none = -2
    reach = [none] * (2 * most + 3)
    for e in range(most + 1):
        now = [none] * (2 * most + 3)
        for d in range(-e, e + 1):
            x = d + most + 1
            i = 0 if e == 0 else max(reach[x] + 1 if reach[x] >= 0 else none, reach[x - 1], reach[x + 1] + 1 if reach[x + 1] >= 0 else none)
            if i < 0 or i < -d:
                continue
            i = min(i, n, m - d)
            if i < 0:
                continue
            i = ends[d + most][i]
            now[x] = i
            if i >= n and i + d >= m:
                return e
        reach = now
    return None


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word by word of b over the band of rows j - most to j + most of a, whose differences are the bits of whole numbers.

    Bit r stands for row j - most + r. `up` and `down` hold where a row costs one more or one less than the row above it; `free`
    holds where a step along the diagonal costs nothing. The cost at the end is the steps of its diagonal that are not free.
    """
    n, m = len(a), len(b)
    words, every, top = a.tolist(), (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    rows: dict[int, tuple[int, int]] = {}  # word -> its rows as bits, and the column that the bits are for
    for i, word in enumerate(words[:most]):
        rows[word] = (rows.get(word, (0, 0))[0] | 1 << (i + most), 0)
    up, down, end, cost = every ^ ((1 << most) - 1), 0, 1 << (most + n - m), 0
    for j, word in enumerate(b.tolist()):
        if j + most < n:
            bits, since = rows.get(enters := words[j + most], (0, j))
            rows[enters] = (bits >> (j - since) | top, j)
        same = 0
        if word in rows:
            bits, since = rows[word]
            same = bits >> (j - since)
        free = ((((same & up) + up) ^ up) | same | down) & every
        right, left = down | (every & ~(free | up)), free & up
        if not free & end:
            cost += 1
            if cost > most:
                return None
        free >>= 1
        up, down = left | (every & ~(free | right)), free & right
    return cost


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    longer = max(len(a), len(b))
    return edits(a, b, int(longer * (1 - SIMILARITY) + 1e-9)) is not None


def sketch_rows(docs: DataFrame) -> DataFrame:
    """node (16 bytes for the text), its sketches and the bytes of the text, for texts with words."""
    rows = docs.select(F.substring(text_key(), 1, 16).alias("node"), "text")

    def run(batch):
        known, nodes, found, sizes = known_words(), [], [], []
        for node, text in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = word_hashes(text or "", known)
            if len(words):
                nodes.append(node)
                found.append(sketches(words).view(np.int64).tolist())
                sizes.append(len(text.encode()))
        return {"node": nodes, "sketches": found, "size": sizes}

    return map_arrow(rows, "node binary, sketches array<long>, size long", run)


def bucket_texts(docs: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """node, text and sketches of every text that shares a bucket. The texts are moved once, by the same plan at every size."""
    named = docs.select(F.substring(text_key(), 1, 16).alias("node"), "text")
    nodes = members.select("node").distinct().hint("merge")
    once = named.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return stored(once.join(found.select("node", "sketches").hint("merge"), "node"), "near-texts")


def verified(pairs: DataFrame, every: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar, with the texts of the nodes in `every`."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().hint("merge")
    texts = stored(every.select("node", "text").join(asked, "node", "left_semi"), "near-asked")
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    both = pairs.join(left, "u").join(right, "v")

    def run(batch):
        known, last, out = known_words(), (None, None), {"u": [], "v": []}
        for u, v, a, b in zip(*(batch[c].to_pylist() for c in ("u", "v", "a", "b")), strict=True):
            if last[0] != v:
                last = (v, word_hashes(b, known))
            if similar(word_hashes(a, known), last[1]):
                out["u"].append(u)
                out["v"].append(v)
        return out

    return map_arrow(both.select("u", "v", "a", "b"), "u binary, v binary", run)


def star_pairs(classes: DataFrame) -> DataFrame:
    """One pair (u, v) for each text that shares buckets with another class: v is the least text of the least class of a bucket,
    the one whose buckets u shares most often.

    classes: bucket, node, root. However large a group of copies is, it gives as many pairs as it has texts.
    """
    heads = classes.groupBy("bucket").agg(F.min(F.struct("root", "node")).alias("head"), F.max("root").alias("most"))
    heads = stored(heads.filter("head.root != most").select("bucket", F.col("head.node").alias("v"), F.col("head.root").alias("of")), "near-heads")
    asked = classes.join(heads, "bucket").filter("root != of").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("n"))
    first = Window.partitionBy("u").orderBy(F.desc("n"), "v")
    return asked.withColumn("k", F.row_number().over(first)).filter("k = 1").select("u", "v")


class Block:
    """The texts of one or two blocks of a bucket, and the classes that are known of them."""

    def __init__(self, group: pa.Table):
        known = known_words()
        self.owns, self.bands = group["own"].to_numpy(), group["band"].to_pylist()
        self.found = group["sketches"].combine_chunks().flatten().to_numpy().reshape(len(self.owns), -1)
        roots = group["root"].to_pylist()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        self.roots = list(number)
        self.classes = np.array([number[r] for r in roots])
        self.words = [word_hashes(text, known) for text in group["text"].to_pylist()]
        self.sizes = np.array([len(w) for w in self.words])
        self.bins = np.stack([bins(w) for w in self.words])

    def open(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` in another class that share a sketch with text i, this bucket's first, and may be similar to it; those
        that share more come first."""
        others = others[self.classes[others] != self.classes[i]]
        most = np.floor(np.maximum(self.sizes[others], self.sizes[i]) * (1 - SIMILARITY) + 1e-9)
        fits = np.abs(self.sizes[others] - self.sizes[i]) <= most
        others, most = others[fits], most[fits]
        agree = self.found[others] == self.found[i]
        fits = agree[:, self.bands[i]] & ~agree[:, : self.bands[i]].any(axis=1)
        others, most, agree = others[fits], most[fits], agree[fits].sum(axis=1)
        more = self.bins[others] - self.bins[i]
        above = np.maximum(more, 0).sum(axis=1, dtype=np.int64)
        fits = np.maximum(above, above - more.sum(axis=1, dtype=np.int64)) <= most
        others, agree = others[fits], agree[fits]
        return others[np.argsort(-agree, kind="stable")]

    def links(self, asking: int, asked: int):
        """Pairs (i, j) of similar texts of two blocks, those that join classes."""
        every = np.flatnonzero(self.owns == asked)
        for i in np.flatnonzero(self.owns == asking).tolist():
            for j in self.open(i, every[every > i] if asking == asked else every).tolist():
                if self.classes[j] != self.classes[i] and similar(self.words[i], self.words[j]):
                    self.classes[self.classes == self.classes[j]] = self.classes[i]
                    yield i, j

    def stars(self, asking: int, asked: int):
        """Pairs of roots (u, v): v is the least root of the classes that two blocks join, u each other one."""
        before = self.classes.copy()
        for _ in self.links(asking, asked):
            pass
        joined: dict[int, set[bytes]] = {}
        for old, new in zip(before.tolist(), self.classes.tolist(), strict=True):
            joined.setdefault(new, set()).add(self.roots[old])
        for roots in joined.values():
            least = min(roots)
            yield from ((u, least) for u in sorted(roots - {least}))


def in_blocks(members: DataFrame) -> DataFrame:
    """bucket, x, y, own, node, root, band: each text in every pair of blocks x, y of its bucket that it has to be in.

    members: bucket, band, node, root, size. Only buckets of several classes count. The largest class of a bucket has blocks of its own,
    which meet the blocks of the other texts but not each other; the others meet all.
    """
    by_class = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    by_bucket = by_class.groupBy("bucket").agg(
        F.max(F.struct("n", "root", "bytes")).alias("largest"),
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"),
    )

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")

    rest = blocks(F.col("n") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes"))
    mixed = by_bucket.filter("classes > 1").select(
        "bucket", F.col("largest.root").alias("of"), rest.alias("rest"), blocks(F.col("largest.n"), F.col("largest.bytes")).alias("large")
    )
    rows = members.join(stored(mixed, "near-mixed"), "bucket")
    dealt, large = F.xxhash64("node", F.lit(1)), F.col("root") == F.col("of")
    rows = rows.withColumn(
        "own", F.when(large, F.col("rest") + F.pmod(dealt, "large")).otherwise(F.pmod(dealt, "rest")).cast("int")
    )
    others = F.sequence(F.lit(0), F.when(large, F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1)
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root", "band")


def block_links(rows: DataFrame) -> DataFrame:
    """Links (u, v) between roots that join all classes of similar texts that meet in a block.

    rows: as `in_blocks` makes them, with sketches and text. A block puts out fewer links than it has texts.
    """
    out = "u binary, v binary"
    schema = arrow_schema(out)

    def run(group: pa.Table) -> pa.Table:
        block = Block(group)
        found = list(block.stars(group["x"][0].as_py(), group["y"][0].as_py()))
        columns = [[pair[k] for pair in found] for k in (0, 1)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.groupBy("bucket", "x", "y").applyInArrow(run, out)


def near_classes(docs: DataFrame) -> DataFrame:
    """node -> root for every text that is similar to another one."""
    found = stored(sketch_rows(docs).dropDuplicates(["node"]), "near-sketches")
    exploded = found.select("node", "size", F.posexplode("sketches").alias("band", "sketch"))
    rows = exploded.select("node", "size", "band", F.xxhash64("band", "sketch").alias("bucket"))
    often = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "near-buckets")
    members = stored(rows.join(often, "bucket", "left_semi"), "near-members")
    texts = bucket_texts(docs, members, found)
    asked = stored(star_pairs(members.withColumn("root", F.col("node"))), "near-stars")
    links = stored(verified(asked, texts), "near-links")
    roots = stored(components(links), "near-roots")
    classes = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = stored(in_blocks(classes), "near-blocks")
    more = stored(block_links(met.join(texts, "node")), "near-links")
    if more.isEmpty():
        return roots
    # Classes are joined by their roots alone; what they were joined from is named after that.
    last = stored(components(more), "near-roots")
    named = roots.join(last.toDF("root", "now"), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return stored(named.unionByName(last).distinct(), "near-roots")


def with_class(docs: DataFrame, name: str = "class_node") -> DataFrame:
    """`docs` with one more column, equal for near duplicates and for copies."""
    if name in docs.columns:
        raise ValueError(f"the input already has a column {name}")
    node, root = free_name(docs, "_node"), free_name(docs, "_root")
    roots = near_classes(docs).toDF(node, root)
    rows = docs.withColumn(node, F.substring(text_key(), 1, 16))
    return rows.join(roots, node, "left").withColumn(name, F.coalesce(root, node)).drop(root, node)


def class_ids(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id and class_id, the least doc_id of its class."""
    keys = docs.select("doc_id", F.substring(text_key(), 1, 16).alias("node"))
    rows = stored(
        keys.join(near_classes(docs), "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_node")),
        "near-classes",
    )
    names = stored(rows.groupBy("class_node").agg(F.min("doc_id").alias("class_id")), "near-names")
    return rows.join(names, "class_node").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the row with the least doc_id; nulls come last, equal ids by the digest of their text, then by the other columns'."""
    rank, of = free_name(docs, "_rank"), free_name(docs, "_class")
    rows = with_class(docs, of)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    order = Window.partitionBy(of).orderBy(F.col("doc_id").asc_nulls_last(), text_key(), F.xxhash64(*hashed))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
