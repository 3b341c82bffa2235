from __future__ import annotations

import random

import numpy as np
import pytest

from tradewind.llm import leaks

ITEMS = "item_id long, text string"


def distance(item: np.ndarray, data: np.ndarray) -> int:
    """Least edits between the item and any stretch of the document."""
    row = np.zeros(len(data) + 1, int)
    steps = np.arange(len(data) + 1)
    for x in item:
        new = np.minimum(row[1:] + 1, row[:-1] + (data != x))
        row = np.minimum.accumulate(np.concatenate(([row[0] + 1], new)) - steps) + steps
    return int(row.min())


def brute(pairs, items):
    out = set()
    for d, text in pairs:
        data = leaks.comparable(text)
        for i, item in items:
            want = leaks.comparable(item)
            if len(want) >= leaks.Q and distance(want, data) <= len(want) // leaks.EDIT_SHARE:
                out.add((d, i))
    return out


def spoil(text, n, seed):
    r, chars = random.Random(seed), list(text)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(chars))
        if k == 0:
            chars[at] = "z"
        elif k == 1:
            chars.insert(at, "q")
        else:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("seed", range(12))
def test_filter_and_alignment_agree_with_full_alignment(prose, seed):
    items = [(k, prose(100 * seed + k, 6 + 9 * k, 60)) for k in range(5)]
    held = leaks.Items(items)
    for k, item in items:
        m = len(leaks.comparable(item))
        for n in (0, 1, m // leaks.EDIT_SHARE, m // leaks.EDIT_SHARE + 1, m // 8):
            text = prose(seed, 30, 60) + " " + spoil(item, n, seed + n) + " " + prose(seed + 1, 30, 60)
            data = leaks.comparable(text)
            got = {i: e for i, (e, _) in held.matches(data).items()}
            want = {}
            for i, other in items:
                d = distance(leaks.comparable(other), data)
                if d <= len(leaks.comparable(other)) // leaks.EDIT_SHARE:
                    want[i] = d
            assert got == want


def test_edge_cases(spark, docs_of, prose):
    item = prose(1, 40)
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "short"), (None, prose(2, 30)), (6, "THE, and - THE; and!")]
    pairs = [
        (1, None), (2, ""), (3, item.upper().replace(" ", " -\n")), (4, prose(3, 8000) + item), (4, prose(3, 8000) + item), (5, item[:-40]),
        (None, item), (7, prose(2, 30)), (8, "the and the and"), (9, prose(4, 200)), (10, item * 3), (11, "é" * 50),
    ]
    found = leaks.find_leaks(docs_of(pairs).repartition(3), spark.createDataFrame(items, ITEMS))
    got = [(r["doc_id"], r["item_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pairs, [x for x in items if x[1] is not None])
    kept = leaks.without_leaks(docs_of(pairs), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 5, 9, 11]


def test_clean_rows_stay_beside_leaked_ones_of_the_same_id(spark, docs_of, prose):
    item = prose(1, 30)
    pairs = [(None, f"before {item} after"), (None, prose(2, 40)), (7, item), (7, prose(3, 40)), (None, None), (8, item)]
    kept = leaks.without_leaks(docs_of(pairs), spark.createDataFrame([(1, item)], ITEMS))
    assert kept.columns == docs_of(pairs).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([pairs[1], pairs[3], pairs[4]], key=repr)


def test_blocks_of_items(spark, docs_of, prose, monkeypatch):
    items = [(k, prose(k, 30)) for k in range(8)]
    pairs = [(k, prose(50 + k, 20) + " " + prose(k, 30)) for k in range(0, 8, 2)]
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 400)
    assert len(list(leaks.blocks(spark.createDataFrame(items, ITEMS)))) > 3
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs_of(pairs), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(k, k) for k in range(0, 8, 2)}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEMS)
    assert leaks.find_leaks(docs_of([(1, "a b c d e f")]), none).collect() == []
    assert leaks.without_leaks(docs_of([(1, "a b c d e f")]), none).count() == 1
    assert leaks.find_leaks(docs_of([]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).collect() == []


def test_query_finds_every_whole_item(spark):
    from tradewind.llm.common import table, tune
    from tradewind.llm.queries import op5_leaks

    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], leaks.comparable(r["text"])) for r in table(tune(spark), sf, "benchmark").collect()]
    docs = [(r["doc_id"], leaks.comparable(r["text"]).tobytes()) for r in table(spark, sf, "documents").collect()]
    whole = {(d, i) for d, t in docs for i, x in items if x.tobytes() in t}
    assert whole and whole <= {(r["doc_id"], r["item_id"]) for r in op5_leaks(spark, sf).collect()}
