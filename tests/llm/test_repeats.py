from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tradewind.llm import repeats


def brute(pairs):
    """Plain version over (doc_id, text) rows."""
    texts = [(t or "").encode() for _, t in pairs]
    seen = Counter(x[i : i + 200] for x in texts for i in range(len(x) - 199))
    out = []
    for (d, _), x in zip(pairs, texts, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone, strict=False))
        out.append((d, len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in columns) for r in repeats.remove_repeats(df).collect()), key=repr)


def test_phrases_cover_every_string(prose):
    data = np.frombuffer((prose(1, 300) + "a" * 700 + prose(2, 50)).encode(), np.uint8)
    starts, strings, triggers = repeats.phrases(data)
    assert starts[0] == 0 and (starts[1:] == (starts + strings)[:-1]).all() and starts[-1] + strings[-1] == len(data) - 199
    h = repeats.rolling(data)
    for s, n, t in zip(starts, strings, triggers, strict=True):
        for i in (s, s + n - 1):
            assert h[i : i + repeats.PLACES].min() == t


def test_ranks_follow_the_bytes(prose):
    data = np.frombuffer((prose(1, 60, 5) * 3).encode(), np.uint8)
    text = data.tobytes()
    strings = [text[i : i + 200] for i in range(len(text) - 199)]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert repeats.string_ranks(data).argsort(kind="stable").tolist() == sorted(range(len(strings)), key=lambda i: (order[strings[i]], i))


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_against_brute_force(docs_of, prose, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    passage = prose(50, 70)
    pairs = [(i, prose(i, 20 + i) + " " + passage[i : 300 + 3 * i] + prose(100 + i, 30)) for i in range(25)]
    copy = prose(60, 200)
    pairs += [(40, copy), (41, copy[:500] + "X" + copy[501:]), (42, copy + copy), (43, "ab" * 700), (44, "ab" * 400), (45, "é" * 150)]
    pairs += [(46, "z" * 199), (47, "z" * 199), (48, "y" * 200), (49, "y" * 200), (51, "x" * 201)]
    assert found(docs_of(pairs).repartition(4)) == brute(pairs)


def test_edge_cases(docs_of, prose):
    long = prose(7, 4000)
    pairs = [(1, None), (2, ""), (3, long), (3, long), (3, prose(8, 90)), (None, prose(8, 90)), (None, None), (None, long[1000:1600]), (5, "short")]
    assert found(docs_of(pairs).repartition(3)) == brute(pairs)
    assert repeats.remove_repeats(docs_of([])).collect() == []


def test_kept_bytes(docs_of, prose):
    shared = prose(1, 60)
    pairs = [(1, "first " + shared + " one"), (2, "other " + shared + " two")]
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in repeats.remove_repeats(docs_of(pairs)).collect()}
    # The blanks around the passage are the same in both, so they belong to it.
    assert got == {1: "firstone", 2: "othertwo"}


def test_query_against_brute_force(spark):
    from tradewind.llm.common import table, tune
    from tradewind.llm.queries import op8_repeats

    sf = "/root/testdata/sf0.001"
    pairs = [(r["doc_id"], r["text"]) for r in table(tune(spark), sf, "documents").collect()]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in op8_repeats(spark, sf).collect()), key=repr) == brute(pairs)
