from __future__ import annotations

import zlib
from collections import Counter

import pytest

from tradewind.llm import shards
from tradewind.llm.common import table, tune


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 257, 1000])
def test_the_walk_is_a_permutation(n):
    places = {shards.locate(i, n, 7) for i in range(n)}
    assert len(places) == n
    sizes = Counter(s for s, _ in places)
    assert max(sizes.values()) - min(sizes.values()) <= 1 if n >= 7 else True
    assert all({p for q, p in places if q == s} == set(range(c)) for s, c in sizes.items())


def test_columns_agree_with_plain_python(spark):
    rows = [(i * 7 % 501, i % 5, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, more int, _tie string").repartition(5)
    got = shards.feistel_shards(df, 40, ["doc_id"])
    assert got.columns == ["doc_id", "more", "_tie", "shard", "slot"]
    order = {d: i for i, d in enumerate(sorted(r[0] for r in rows))}
    for r in got.collect():
        assert (r["shard"], r["slot"]) == shards.locate(order[r["doc_id"]], 500, 40)


def test_layout_does_not_matter(spark):
    df = spark.range(300).selectExpr("id AS doc_id")
    a = shards.feistel_shards(df.repartition(1), 9, ["doc_id"]).collect()
    b = shards.feistel_shards(df.repartition(7), 9, ["doc_id"]).collect()
    assert sorted(a) == sorted(b)


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (None,), (5,), (5,), (5,), (1,)], "doc_id long")
    got = shards.feistel_shards(df, 2, ["doc_id"]).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert shards.feistel_shards(df.limit(0), 2, ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="slot"):
        shards.feistel_shards(df.selectExpr("doc_id", "1 AS slot"), 2, ["doc_id"])


def test_plan_has_no_python(spark):
    plan = shards.feistel_shards(spark.range(50).selectExpr("id AS doc_id"), 4, ["doc_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_query_against_plain_python(spark):
    from tradewind.llm.queries import SHARDS, op3_shards

    sf = "/root/testdata/sf0.001"
    docs = table(tune(spark), sf, "documents").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in op3_shards(spark, sf).collect()}
    for i, d in enumerate(docs):
        data, r = (d["text"] or "").encode(), got[d["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert (r["shard"], r["slot"]) == shards.locate(i, len(docs), SHARDS)
        assert r["law"] == "rows" and r["grown_shard"] is None
