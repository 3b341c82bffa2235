from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tradewind.llm import bpe
from tradewind.llm.common import table, tune
from tradewind.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.rank_file(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def judge(vocab):
    return tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def row(judge, text):
    ids = judge.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_every_token_encodes_to_itself(vocab):
    assert all(vocab.encode_piece(t) == [i] for t, i in vocab.ranks.items())


def test_random_texts(vocab, judge):
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "😀", "1", "²", "the", "ing", "'s", "　", "\x1c", "\u0085", "​", "tion", " re", "ß", "İ", "ﬁ", "\t", "_"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(60)))
        ids = vocab.encode(text)
        assert ids == judge.encode_ordinary(text), text
        assert vocab.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["a", " ", "ab", "thetion", "é", "zq"])
def test_long_pieces(vocab, judge, unit):
    text = unit * (40_000 // len(unit))
    assert vocab.encode(text) == judge.encode_ordinary(text)


def test_other_vocabulary():
    data = bpe.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = bpe.read_ranks(data)
    v = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    j = tiktoken.Encoding("j", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = open(bpe.__file__).read() + "\n\n   naïve 123 ¿qué? 漢字"
    assert v.encode(text) == j.encode_ordinary(text)


def test_edge_cases(docs_of, judge, prose):
    pairs = [(1, None), (2, ""), (3, prose(1, 5000)), (4, "same"), (4, "same"), (None, "漢 \n")]
    docs = docs_of(pairs).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    rows = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted([(i, *row(judge, t)) for i, t in pairs], key=repr)
    assert {r["doc_id"]: len(r["ids"]) for r in got.collect()}[2] == 0
    assert bpe.encode_documents(docs_of([]), PATH, public_tokenizers.PATTERN).collect() == []


def test_query_against_the_library(spark, judge):
    from tradewind.llm.queries import op10_byte_bpe

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: row(judge, r["text"]) for r in table(tune(spark), sf, "documents").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op10_byte_bpe(spark, sf).collect()}
    assert got == want
