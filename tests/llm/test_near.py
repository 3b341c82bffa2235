from __future__ import annotations

import random

import numpy as np
import pytest

from tradewind.llm import components as cc
from tradewind.llm import near


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def vary(words, n, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(max(1, len(out)))
        if k == 1 or not out:
            out.insert(at, "more")
        elif k == 0:
            out[at] = "new"
        else:
            del out[at]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_alignment(seed):
    r = random.Random(seed)
    a = [r.randrange(r.choice([2, 5, 30])) for _ in range(r.randrange(40))]
    b = [x if isinstance(x, int) else 99 for x in vary(a, r.randrange(10), seed)] if a else [1, 2]
    true = plain_distance(a, b)
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    for most in (0, 1, 3, 6, 15, 40):
        assert near.edits(x, y, most) == (true if true <= most else None)
        if len(a) and abs(len(a) - len(b)) <= most:
            short, long = (x, y) if len(a) <= len(b) else (y, x)
            assert near._banded(short, long, most) == near._furthest(short, long, most) == (true if true <= most else None)


def test_sketches_keep_text_order():
    words = np.array([near.WordHashes()[f"w{i}"] for i in range(400)], np.uint64)
    same = (near.sketches(words) == near.sketches(words.copy())).mean()
    turned = (near.sketches(words) == near.sketches(np.concatenate((words[200:], words[:200])))).mean()
    assert same == 1 and turned < 0.8  # the same k-mers, but about half of the pairs in another order


def test_occurrences_count():
    one = np.array([7] * 30, np.uint64)
    assert len(set(near.kmers(one).tolist())) == 26
    assert set(near.kmers(one[:20]).tolist()) < set(near.kmers(one).tolist())


def brute(pairs):
    known = near.WordHashes()
    words = [near.word_hashes(t or "", known) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            a, b = words[i], words[j]
            equal = (pairs[i][1] or "") == (pairs[j][1] or "")
            if equal or (len(a) and len(b) and near.similar(a, b)):
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(pairs):
        out.setdefault(find(i), []).append(d)
    return sorted(
        ((d, min((x for x in g if x is not None), default=None)) for g in out.values() for d in g), key=repr
    )


def classes(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in near.class_ids(df).collect()), key=repr)


def test_classes_against_brute_force(docs_of, prose):
    base = prose(1, 120).split()
    pairs = [(i, " ".join(vary(base, 3, i))) for i in range(40)]  # one group of near copies
    pairs += [(100 + i, prose(200 + i, 150)) for i in range(20)]
    pairs += [(200 + i, prose(300, 70) + " " + prose(400 + i, 70)) for i in range(20)]  # share a passage, not more
    pairs += [(300, " ".join(base).upper()), (301, prose(200, 150) + " end"), (302, "same same " * 200), (303, "same same " * 190)]
    assert classes(docs_of(pairs).repartition(4)) == brute(pairs)


def test_edge_cases(docs_of, prose):
    long = prose(9, 6000)
    pairs = [
        (5, None), (6, ""), (7, " \n"), (8, "two words"), (9, "two words"), (9, "two words"), (10, "Two  words"), (11, long),
        (12, long + " more"), (None, long), (None, prose(3, 40)), (13, prose(4, 40)),
    ]
    got = classes(docs_of(pairs).repartition(3))
    assert got == sorted(
        [(5, 5), (6, 5), (7, 7), (8, 8), (9, 8), (9, 8), (10, 8), (11, 11), (12, 11), (None, 11), (None, None), (13, 13)], key=repr
    )
    assert near.class_ids(docs_of([])).collect() == []
    kept = near.one_of_each(docs_of(pairs).selectExpr("*", "1 AS root", "2 AS node", "3 AS _rank"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([5, 7, 8, 11, None, 13], key=repr)
    assert kept.columns[-3:] == ["root", "node", "_rank"]


def test_blocks_join_all_classes_of_a_bucket(spark, prose, monkeypatch):
    """Buckets are compared through in blocks; the largest class does not meet itself, all others meet."""
    monkeypatch.setattr(near, "BLOCK", 4)
    one, two, three = (prose(i, 60).split() for i in (1, 2, 3))
    texts = [" ".join(vary(one, 2, i)) for i in range(19)]  # one class so far
    texts += [" ".join(vary(words, 2, 30 + i)) for i, words in enumerate([two] * 6 + [one] * 2 + [three] * 5)]
    texts += [prose(100 + i, 60) for i in range(7)]
    rows = [(1, 0, bytes([i]), bytes([0 if i < 19 else i]), len(t)) for i, t in enumerate(texts)]
    rows += [(2, 1, bytes([i]), bytes([0]), 5) for i in range(4)]  # one class only
    members = spark.createDataFrame(rows, "bucket long, band int, node binary, root binary, size long")
    met = near.in_blocks(members)
    groups = {}
    for r in met.collect():
        assert r["bucket"] == 1
        groups.setdefault((r["x"], r["y"]), []).append(r["node"][0])
    assert all(any(i >= 19 for i in g) for k, g in groups.items() if k[0] != k[1])
    together = {frozenset((i, j)) for g in groups.values() for i in g for j in g}
    assert all(frozenset((i, j)) in together for i in range(19, len(texts)) for j in range(len(texts)))

    found = [1] + [0] * (near.SKETCHES - 1)
    named = spark.createDataFrame([(bytes([i]), found, t) for i, t in enumerate(texts)], "node binary, sketches array<long>, text string")
    links = [(r["u"][0], r["v"][0]) for r in near.block_links(met.join(named, "node")).collect()]
    root = [0 if i < 19 else i for i in range(len(texts))]
    for u, v in links:
        root = [min(root[u], root[v]) if r in (root[u], root[v]) else r for r in root]
    assert root == [0] * 19 + [19] * 6 + [0] * 2 + [27] * 5 + list(range(32, 39))
    # A pair that an earlier band has in common is left to that bucket.
    later = met.withColumn("band", near.F.lit(1))
    assert near.block_links(later.join(named, "node")).collect() == []


def test_failing_partners_do_not_hide_others(docs_of, prose):
    """Texts that share a passage agree in more sketches than planted pairs do, but are not similar."""
    passage = prose(1, 100).split()
    pairs = [(i, " ".join(passage + prose(1000 + i, 60).split())) for i in range(240)]
    for i in range(40):
        own = prose(3000 + i, 60).split()
        near_passage = vary(passage, 10, i)
        pairs += [(500 + 2 * i, " ".join(passage + own)), (501 + 2 * i, " ".join(near_passage + vary(own, 14, 50 + i)))]
    known = near.WordHashes()
    words = [near.word_hashes(t, known) for _, t in pairs]
    found = np.array([near.sketches(w) for w in words])
    root = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in np.flatnonzero((found[:i] == found[i]).any(axis=1)).tolist():
            if near.similar(words[i], words[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted(((pairs[i][0], pairs[r][0]) for i, r in enumerate(root)), key=repr)
    assert sum(d != c for d, c in want) >= 25
    assert classes(docs_of(pairs).repartition(4)) == want


def test_bounds_never_exceed_the_edits():
    known = near.WordHashes()
    for seed in range(80):
        r = random.Random(seed)
        a = [f"w{r.randrange(r.choice([3, 40, 4000]))}" for _ in range(r.choice([3, 40, 900]))]
        texts = [" ".join(w) for w in (a, vary(a, r.randrange(1 + len(a) // 5), seed))]
        x, y = (near.word_hashes(t, known) for t in texts)
        table = {"own": [0, 0], "band": [0, 0], "node": [b"a", b"b"], "root": [b"a", b"b"], "sketches": [[1], [1]], "text": texts}
        got = near.Block(near.pa.table(table)).open(0, np.array([0, 1]))
        assert not near.similar(x, y) or got.tolist() == [1]


def test_one_of_each_has_defined_ties(spark, prose):
    base = prose(5, 80).split()
    texts = [" ".join(vary(base, 2, i)) for i in range(3)]
    rows = [(1, t, lang) for t in texts for lang in ("b", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [near.one_of_each(df.repartition(n)).collect() for n in (1, 3)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] and kept[0] == near.one_of_each(spark.createDataFrame(rows[::-1], df.schema)).collect()


def test_alignment_of_long_texts():
    r = random.Random(3)
    a = [r.randrange(50_000) for _ in range(60_000)]
    b = [x if isinstance(x, int) else 99 for x in vary(a, 200, 1)]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    got = near.edits(x, y, 12_000)
    assert got is not None and 150 <= got <= 200 and near.edits(x, y, got - 1) is None
    assert near.edits(x, y[::-1].copy(), 12_000) is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in cc.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert cc.components(df.limit(0)).collect() == []


def test_components_of_any_graph(spark):
    r = random.Random(4)
    for n, m in ((60, 30), (60, 60), (200, 180), (40, 300)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for u, v in edges:
            root = [min(root[u], root[v]) if x in (root[u], root[v]) else x for x in root]
        got = {x["node"]: x["root"] for x in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {i: root[i] for e in edges if e[0] != e[1] for i in e}


def test_components_take_few_rounds(spark, monkeypatch):
    """Links to one smaller node each take large stars alone, which halve their depth; a round that would change nothing is not taken."""
    written, store = [], cc.stored
    monkeypatch.setattr(cc, "stored", lambda df, name: written.append(name) or store(df, name))
    chains = [(100 * k + i, 100 * k + i - 1) for k in range(5) for i in range(1, 9)]
    got = cc.components(spark.createDataFrame(chains, "u long, v long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(100 * k + i, 100 * k) for k in range(5) for i in range(9)]
    assert len(written) == 8  # the edges, three rounds of two tables, and the look that ends them


def test_blocks_put_out_stars_of_roots(prose):
    words = prose(1, 60).split()
    texts = [" ".join(vary(words, 1, i)) for i in range(6)]
    table = {"own": [0] * 6, "band": [0] * 6, "node": [bytes([i]) for i in range(6)], "root": [bytes([i // 2 * 2]) for i in range(6)]}
    block = near.Block(near.pa.table(table | {"sketches": [[1]] * 6, "text": texts}))
    assert list(block.stars(0, 0)) == [(bytes([2]), bytes([0])), (bytes([4]), bytes([0]))]


def test_query_against_brute_force(spark):
    from tradewind.llm.common import table, tune
    from tradewind.llm.queries import op7_near

    sf = "/root/testdata/sf0.001"
    pairs = [(r["doc_id"], r["text"]) for r in table(tune(spark), sf, "documents").collect()]
    got = sorted(((r["doc_id"], r["class_id"]) for r in op7_near(spark, sf).collect()), key=repr)
    assert got == brute(pairs)
