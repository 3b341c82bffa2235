from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tradewind.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.8
        words = [f"word{r.randrange(300)}" for _ in range(r.randrange(20, 200))]
        rows.append((i, " ".join(words) + "." if good else "$$$ ".join(words).upper(), int(good)))
    return rows


def test_pair_sum_identity():
    rng = np.random.default_rng(0)
    size = quality.STATISTICS + quality.BUCKETS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    row = ([20, 30, 41], [0.5, 0.2, 0.7], rng.normal(size=quality.STATISTICS).tolist())
    ids, values, starts = m.rows([row, row])
    n = quality.STATISTICS + 3
    slow = 0.3 + sum(m.linear[i] * v for i, v in zip(ids[:n], values[:n], strict=True))
    for a in range(n):
        for b in range(a):
            slow += m.factors[ids[a]] @ m.factors[ids[b]] * values[a] * values[b]
    assert m.sums(ids, values, starts)[0] == pytest.approx([slow, slow])


def test_held_out_accuracy_and_columns(spark, docs_of):
    rows = corpus(500)
    docs = docs_of([(i, t) for i, t, _ in rows]).selectExpr("*", "1 AS _chars")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)
    scored = quality.score_documents(docs, quality.train(docs, labels))
    assert scored.columns == [*docs.columns, "score"]
    want = {i: q for i, _, q in rows}
    got = {r["doc_id"]: r for r in scored.withColumn("out", quality.held_out()).collect()}
    assert all(got[i]["out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in want)
    out = [i for i in want if got[i]["out"]]
    assert np.mean([(got[i]["score"] >= quality.THRESHOLD) == want[i] for i in out]) > 0.95
    assert got[0]["text"] == rows[0][1] and got[0]["n_chars"] == len(rows[0][1]) and got[0]["lang"] == "en"


def test_held_out_labels_and_other_columns_do_not_matter(spark, docs_of):
    rows = corpus(120)
    docs = docs_of([(i, t) for i, t, _ in rows])
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)
    b = spark.createDataFrame([(i, 1 - q if out(i) else q, 1) for i, _, q in rows], LABELS).repartition(5)
    other = docs.selectExpr("doc_id", "text", "'de' AS lang", "'zz' AS source", "n_chars")
    one = sorted((r["doc_id"], r["score"]) for r in quality.score_documents(docs, quality.train(docs, a)).collect())
    two = sorted((r["doc_id"], r["score"]) for r in quality.score_documents(other, quality.train(other, b)).collect())
    assert [i for i, _ in one] == [i for i, _ in two]
    assert [s for _, s in one] == pytest.approx([s for _, s in two], abs=1e-9)


def test_edge_cases(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000), (None, "a b"), (5, "é\n" * 50)])
    for rows in ([], [(1, 1, 0)], [(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (3, 1, 0), (5, 0, 0)]):
        model = quality.train(docs, spark.createDataFrame(rows, LABELS))
        scores = [r["score"] for r in quality.score_documents(docs, model).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    empty = docs_of([])
    assert quality.score_documents(empty, quality.train(empty, spark.createDataFrame([], LABELS))).collect() == []
    with pytest.raises(ValueError, match="score"):
        quality.score_documents(docs.selectExpr("*", "1 AS score"), model)


def test_query_keeps_good_and_rejects_bad(spark):
    from tradewind.llm.common import table, tune
    from tradewind.llm.queries import op9_quality

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(tune(spark), sf, "labels").collect()}
    rows = [r for r in op9_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert rows and np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
