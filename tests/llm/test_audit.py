from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tradewind.llm import audit
from tradewind.llm.common import table, tune

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
    }


def plain(docs, labels):
    """Every order walked over every document."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    judged = []
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, text, lang in docs:
        f = fails(text or "") | {"E": d is not None and d > least[text or ""]}
        judged.append((lang or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    shapley = Counter()
    for part in {j[0] for j in judged}:
        for order in audit.ORDERS:
            left = [j for j in judged if j[0] == part]
            own = left
            for step, name in enumerate(order, 1):
                gone = [j for j in left if name in j[1]]
                left = [j for j in left if name not in j[1]]
                shapley[part, name] += len(gone)
                failing = sum(name in j[1] for j in own)
                unique = sum(j[1] == {name} for j in own)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), unique, sum(j[2] for j in gone), sum(j[3] for j in gone))
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_positional_counts():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 100, 4097):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_counts(words).tolist() == [sum(int(w) >> b & 1 for w in words) for b in range(32)]


def test_words_are_truth_tables():
    for failing, word in enumerate(audit.WORDS.tolist()):
        assert [bool(word >> s & 1) for s in range(32)] == [not s & failing for s in range(32)]


def test_words_held_back_and_parts_flushed():
    tally = audit.PartCounts()
    for k in range(40):
        words = audit.WORDS[np.full(5000, k % 32)]
        tally.add("p", words, [slice(None), np.arange(5000) % 2 == 0, np.zeros(5000, bool)])
    got = tally.rows()
    assert got["everyone"][0][0] == 200_000 and got["good"][0][0] == 100_000 and got["toxic"][0][0] == 0
    assert tally.rows()["part"] == []


def documents(seed, n=160):
    r = random.Random(seed)
    texts = []
    for _ in range(n // 2):
        vocabulary = [f"w{i}" for i in range(r.choice([3, 150, 2000]))] + r.choice([[], ["ABC"], ["#"], ["X", "$5", "| |"]])
        texts.append(r.choice([" ", "\n", "\t\x0b", "\xa0 "]).join(r.choice(vocabulary) for _ in range(r.choice([0, 10, 199, 200, 260]))))
    return [(r.randrange(n), r.choice(texts), r.choice(["en", "de", "", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walks(spark, seed):
    docs = documents(seed)
    r = random.Random(seed)
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1])) for d in range(100)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    got = audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert rows(got) == plain(docs, labels)


def test_edge_cases(spark, prose):
    long = prose(1, 300_000)
    docs = [(1, None, None), (2, "", "en"), (None, "", "en"), (None, "x", ""), (4, "x", None), (4, "x", "en"), (4, "x", "en"), (3, "x", "fr"), (9, long, "en"), (8, long, "en")]
    labels = [(4, 1, None), (None, 1, 1), (8, None, 1)]
    given = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS part", "2 AS fails", "3 AS digest", "4 AS good", "5 AS toxic", "6 AS first")
    assert rows(audit.filter_audit(given, spark.createDataFrame(labels, LABELS))) == plain(docs, labels)


def test_copies_and_empty_tables(spark):
    docs = [(i, "copy", "en") for i in range(500)]
    assert rows(audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))) == plain(docs, [])
    assert rows(audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))) == []


def test_query_on_whole_table(spark):
    from tradewind.llm.queries import op12_audit

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(tune(spark), sf, "documents").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in table(spark, sf, "labels").collect()]
    assert rows(op12_audit(spark, sf)) == plain(docs, labels)
