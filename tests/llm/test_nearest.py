from __future__ import annotations

import numpy as np
import pytest

from tradewind.llm import nearest as nn

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids.tolist()):
        if i % 50 == 0:
            s = x @ x[n]
            order = np.lexsort((ids, -np.round(s, 10)))
            out[i] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != i][:k]
    return out


def found(spark, df):
    out = {}
    for r in nn.nearest(df).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=48).tolist()) for i in range(3000)]
    got, want = found(spark, frame(spark, rows)), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, best in got.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True)
        for i, s in best:
            assert s == pytest.approx(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]), abs=1e-12)


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 10, rng.normal(size=20).tolist()) for i in range(60)]
    got, want = found(spark, frame(spark, rows)), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_a_full_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nn, "BLOCK_QUERIES", 2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [3.0, -1.0, i * 0.1 + 1]) for i in range(80)]
    got = found(spark, frame(spark, rows))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350}


def test_unusable_vectors_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(50 * (i + 10), v) for i, v in enumerate(bad)] + [(None, [1.0, 1.0]), (0, [1.0, 0.0]), (3, [1e-30, 1e-30]), (4, [3e30, 1e30])]
    rows += [(4, [5e30, 9e30])]
    got = found(spark, frame(spark, rows))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [4, 3]}
    assert nn.nearest(frame(spark, rows[:4])).collect() == [] and nn.nearest(frame(spark, [])).collect() == []


def test_no_query_no_rows(spark):
    assert nn.nearest(frame(spark, [(1, [1.0, 0.0]), (2, [0.5, 1.0])])).collect() == []
    assert nn.nearest(frame(spark, [(50, [1.0, 0.0])])).collect() == []


def test_query_recall(spark):
    from tradewind.llm.common import table, tune
    from tradewind.llm.queries import op6_nearest

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in table(tune(spark), sf, "embeddings").collect()]
    want, got = brute(rows), {}
    for r in op6_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))
