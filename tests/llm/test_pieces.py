from __future__ import annotations

import hashlib
import random
import string
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.llm import pieces
from tradewind.llm.common import table, tune
from tradewind.llm.queries import PIECES

PATH = public_tokenizers.path(PIECES)
MODEL = pieces.PieceModel(pieces.model_file(PATH))
JUDGE = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = "a b the ing tion re é 漢 한국 😀 ß İ ﬁ ▁ == ---- 1 ab".split() + [" ", "  ", " " * 40, "\n", "\t", "　", "\x00", "​", "ab" * 50]


def same(texts):
    for text, ids in zip(texts, MODEL.encode_batch(texts), strict=True):
        want = JUDGE.encode(text, add_eos=True)
        assert ids == want, text
        assert MODEL.decode(ids) == JUDGE.decode(want)


def row(text):
    ids = JUDGE.encode(text or "", add_eos=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(JUDGE.decode(ids))


def test_random_texts():
    r = random.Random(8)
    for _ in range(60):
        same(["".join(r.choice(PARTS) for _ in range(r.randrange(70))) for _ in range(40)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


@pytest.mark.parametrize("unit", ["a", " ", "ab", "thetion", "é", "-", "zq", "漢字", "x y", "e\n"])
def test_long_words(unit):
    for tail in ("", "the", " end", "😀"):
        same([unit * (60_000 // len(unit)) + tail])


def test_long_random_word():
    r = random.Random(2)
    same(["".join(r.choice(string.ascii_letters + string.digits) for _ in range(120_000))])
    same(["".join(r.choice(["the", "ing", "er", "a", "e", "st", "tion"]) for _ in range(40_000))])


@pytest.mark.parametrize("n", [*range(1, 36), 63, 64, 65, 1000])
def test_runs_of_blanks(n):
    same([" " * n, " " * n + "the", "a" + " " * n + "漢", "a" + " " * n, "x" + " " * n + "\n" + " " * n + "y"])


def test_decoding_of_any_ids():
    r = random.Random(5)
    pool = [0, 1, 2, 259, 28705, 300, 29000, *range(3, 259)]
    for _ in range(3000):
        ids = [r.choice(pool) for _ in range(r.randrange(8))]
        assert MODEL.decode(ids) == JUDGE.decode(ids), ids


def message(number, value):
    size, head = len(value), []
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    return bytes([number << 3 | 2, *head, size]) + value


def model_of(scored, trainer=b"\x18\x02\xc0\x02\x01\x98\x02\x01", normalizer=b"\x20\x00"):
    """A model file with these pieces, byte pieces and three special ones."""
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    out = b""
    for text, score, kind in special + [(t, s, 1) for t, s in scored]:
        out += message(1, message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([24, kind]))
    return out + message(2, trainer) + message(3, normalizer)


def test_models_whose_longer_pieces_come_first():
    """Scores in any order: a merge may make a pair that goes before the merge itself, and many pairs tie."""
    r = random.Random(3)
    for k in range(40):
        texts = {"".join(r.choice("abc▁") for _ in range(r.randrange(2, 7))) for _ in range(40)} | set("abc▁")
        scored = [(t, float(-r.randrange(1, 30 if k % 2 else 4))) for t in sorted(texts)]
        data = model_of(scored, trainer=b"\x18\x02\x98\x02\x01")
        own, judge = pieces.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        words = ["".join(r.choice("abc ") for _ in range(r.choice([3, 9, 30, 300]))) for _ in range(30)]
        for text, ids in zip(words, own.encode_batch(words), strict=True):
            assert ids == judge.encode(text, add_eos=True), (text, scored)


def test_one_look_up_a_round(monkeypatch):
    """Pairs that merges make are looked up once, and before that only beside pieces that may be followed too early."""
    own = pieces.PieceModel(model_of([("a", -9.0), ("b", -9.0), ("ab", -1.0), ("abab", -2.0), ("ababab", -3.0)], trainer=b"\x18\x02\x98\x02\x01"))
    calls = {"lookup": 0, "_merges": 0}
    for name in calls:
        plain = getattr(own, name)
        monkeypatch.setattr(own, name, lambda *a, n=name, f=plain: calls.update({n: calls[n] + 1}) or f(*a))
    own.encode_words(["abababab", "bab" * 7])
    assert calls["lookup"] == calls["_merges"] > 2


def test_words_are_forgotten_and_come_again(monkeypatch):
    monkeypatch.setattr(pieces, "KEEP_WORDS", 20)
    r = random.Random(12)
    for _ in range(30):
        same(["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(5)] + ["", "the same words", "x" * 300])
    with pytest.raises(UnicodeEncodeError):
        MODEL.encode_batch(["new \ud800 words"])
    same(["new words", "the same words"])


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="BPE"):
        pieces.PieceModel(model_of([("a", -1.0)], trainer=b"\x18\x01\x98\x02\x01"))
    with pytest.raises(ValueError, match="BPE"):
        pieces.PieceModel(model_of([("a", -1.0)], trainer=b"\x18\x02\x98\x02\x01", normalizer=b"\x20\x01"))


def test_edge_cases(docs_of, prose):
    pairs = [(1, None), (2, ""), (3, prose(1, 5000)), (4, "same"), (4, "same"), (None, "漢 \n"), (5, "word " * 600_000)]
    docs = docs_of(pairs).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = pieces.encode_pieces(docs, PATH).collect()
    rows = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got]
    assert sorted(rows, key=repr) == sorted([(i, *row(t)) for i, t in pairs], key=repr)
    assert {r["doc_id"]: r["ids"] for r in got}[2] == [MODEL.end]
    assert pieces.encode_pieces(docs_of([]), PATH).collect() == []


def test_query_against_the_library(spark):
    from tradewind.llm.queries import op13_pieces

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: row(r["text"]) for r in table(tune(spark), sf, "documents").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op13_pieces(spark, sf).collect()}
    assert got == want
