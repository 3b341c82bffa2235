from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tradewind.llm import search
from tradewind.llm.common import table, tune

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def plain(docs, items, top=20):
    """The contract, document by document."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    split = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in split if w]
    total = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries: dict = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in queries.items():
        found = []
        for doc, counts, n in held:
            m = 75 + (25 * n * len(held)) // total
            score = 0
            for t, repeats in wanted.items():
                if t in counts:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                    score += repeats * w * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_against_plain_scores(spark, docs_of, block_bytes):
    r = random.Random(block_bytes)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "漢字", "Mixed", "mixed", "a_b", "x-y", "7"]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randrange(most)))
    docs = [(i, text(80)) for i in range(300)]
    items = [(i, text(12)) for i in range(25)]
    assert rows(search.search(docs_of(docs).repartition(5), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)) == plain(docs, items)


def test_edge_cases(spark, docs_of, prose):
    same = "one two three"
    docs = [(i, same) for i in range(60)] + [(5, same), (None, same), (None, None), (90, ""), (91, None), (92, "!!! ..."), (93, prose(3, 200_000) + " two")]
    items = [(1, "two two three"), (2, None), (2, "one"), (None, "three"), (3, "absent"), (4, "!?"), (1, "two two three")]
    given = docs_of(docs).selectExpr("*", "1 AS score", "2 AS item", "3 AS rank", "4 AS item_id")
    extra = spark.createDataFrame(items, ITEMS).selectExpr("*", "9 AS doc_id", "8 AS block", "7 AS term")
    assert rows(search.search(given, extra)) == plain(docs, items)


def test_null_ids_come_last_and_repeats_count(spark, docs_of):
    docs = [(None, "a b"), (2, "a b"), (1, "a b"), (2, "a b"), (7, "c"), (8, "c"), (9, "d"), (10, "e"), (11, "f")]
    got = rows(search.search(docs_of(docs), spark.createDataFrame([(0, "a")], ITEMS)))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [1, 2, 2, None]
    assert [r[2] for r in rows(search.search(docs_of(docs), spark.createDataFrame([(0, "a")], ITEMS), top=2))] == [1, 2]


def test_empty_tables(spark, docs_of):
    one = spark.createDataFrame([(1, "a")], ITEMS)
    assert rows(search.search(docs_of([]), one)) == []
    assert rows(search.search(docs_of([(1, "a")]), spark.createDataFrame([], ITEMS))) == []


def test_blocks_are_bounded(spark):
    items = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(99, "y" * 5000)], ITEMS)
    sizes = {}
    for r in search.item_blocks(items, 400).collect():
        sizes.setdefault(r["block"], []).append(len(r["text"]))
    assert all(sum(s) <= 400 or len(s) == 1 for s in sizes.values())


def test_query_on_whole_table(spark):
    from tradewind.llm.queries import op11_search

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(tune(spark), sf, "documents").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert rows(op11_search(spark, sf)) == plain(docs, items)
