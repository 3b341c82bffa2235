from __future__ import annotations

import os
import sys

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402
from test_leaks import brute as leak_pairs  # noqa: E402
from test_lines import brute as line_rows  # noqa: E402
from test_near import brute as near_classes  # noqa: E402
from tradewind.llm import bpe, quality  # noqa: E402
from tradewind.llm.common import stored, table, tune  # noqa: E402
from tradewind.llm.queries import VOCABULARY  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = table(tune(spark), SF, "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(results):
    assert [n for n, _ in cp.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE encoding and decoding",
    ]
    for df in results[:-1]:
        assert df.dtypes == results[0].dtypes


def test_quality_stage(spark, results):
    before, after = results[0], results[1]
    model = quality.train(before, table(spark, SF, "labels"))
    keep = {r["doc_id"] for r in quality.score_documents(before, model).collect() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in after.collect()} == keep
    assert set(after.collect()) <= set(before.collect())
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert all(i in keep for i, q in labels.items() if q == 1)


def test_line_stage(results):
    before, after = pairs(results[1]), pairs(results[2])
    want = line_rows(before)
    assert after == sorted((i, want[i, t][0]) for i, t in before if not want[i, t][1] or want[i, t][0])
    n = {r["doc_id"]: r["n_chars"] for r in results[2].collect()}
    assert all(n[i] == len(t) for i, t in after if want[i, dict(before)[i]][1])


def test_near_stage(results):
    classes = near_classes(pairs(results[2]))
    assert [i for i, _ in pairs(results[3])] == sorted({c for _, c in classes})


def test_leak_stage(spark, results):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    short = [(i, t) for i, t in pairs(results[3]) if len(t) < 3000]
    bad = {i for i, _ in leak_pairs(short, items)}
    kept = {i for i, _ in pairs(results[4])}
    assert {i for i, _ in short} - kept == bad


def test_bpe_stage(results):
    ranks = bpe.read_ranks(bpe.rank_file(public_tokenizers.path(VOCABULARY)))
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in results[5].collect()}
    assert got == {i: judge.encode_ordinary(t) for i, t in pairs(results[4])}


def test_run_is_all_stages(spark, results):
    assert sorted(cp.run(spark, SF).collect()) == sorted(results[5].collect())


def test_empty_documents(spark, docs_of, tmp_path):
    empty = docs_of([])
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in cp.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.collect() == []
