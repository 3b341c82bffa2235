from __future__ import annotations

import hashlib
import random

from tradewind.llm import chunks
from tradewind.llm.common import table, tune


def brute(pairs):
    """Plain version of the operator over (doc_id, text)."""
    rows = sorted({(i is None, i or 0, t or "") for i, t in pairs})
    seen, out = {}, {}
    for unknown, i, text in rows:
        data, at, marks = text.encode(), 0, []
        for end in chunks.cuts(data):
            piece = data[at:end]
            home = seen.setdefault(piece, (unknown, i, text, at))
            marks.append((at, end, len(piece) >= chunks.MIN_REPEAT and home != (unknown, i, text, at)))
            at = end
        kept, k = b"", 0
        while k < len(marks):
            stop = k
            while stop < len(marks) and marks[stop][2]:
                stop += 1
            if stop == k:
                kept += data[marks[k][0] : marks[k][1]]
                k += 1
                continue
            run = data[marks[k][0] : marks[stop - 1][1]]
            if len(run) < chunks.MIN_RUN and len(run) < len(data):
                kept += run
            k = stop
        out[None if unknown else i, text] = (len(data), len(data) - len(kept), hashlib.sha256(kept).hexdigest())
    return out


def check(df, pairs):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in chunks.dedupe_chunks(df, keep_text=False).collect()]
    want = brute(pairs)
    assert sorted(got, key=repr) == sorted([(i, *want[i, t or ""]) for i, t in pairs], key=repr)


def test_cuts_resist_insertions(prose):
    data = prose(1, 800).encode()
    a, b = set(chunks.cuts(data)), {c - 7 for c in chunks.cuts(b"inserte" + data)}
    assert len(a & b) > 0.95 * len(a)
    ends = chunks.cuts(data)
    assert ends[-1] == len(data) and max(y - x for x, y in zip([0, *ends], ends, strict=False)) <= chunks.MOST


def test_a_passage_in_the_middle_is_removed(docs_of, prose):
    passage = prose(99, 60)
    pairs = [(1, prose(1, 90) + " " + passage + " " + prose(2, 50)), (2, prose(3, 40) + " " + passage + " " + prose(4, 80))]
    rows = {r["doc_id"]: r for r in chunks.dedupe_chunks(docs_of(pairs)).collect()}
    assert rows[1]["n_removed"] == 0 and bytes(rows[1]["kept"]).decode() == pairs[0][1]
    assert rows[2]["n_removed"] > len(passage) / 2 and rows[2]["n_spans"] == 1
    check(docs_of(pairs), pairs)


def test_passages_of_fifty_short_words_are_caught(docs_of):
    """Of passages a little over fifty words of natural length nearly all lose half of their bytes or more, wherever they lie."""
    r = random.Random(21)
    text = lambda n: " ".join("".join(r.choices("etaoinshrdlu", k=r.choice([2, 3, 3, 4, 4, 5, 6]))) for _ in range(n))
    passages = [text(r.randrange(51, 56)) for _ in range(150)]
    pairs = [(2 * i + k, f"{text(r.randrange(3, 40))} {p} {text(r.randrange(3, 40))}") for i, p in enumerate(passages) for k in (0, 1)]
    rows = {x["doc_id"]: x["n_removed"] for x in chunks.dedupe_chunks(docs_of(pairs), keep_text=False).collect()}
    assert all(rows[2 * i] == 0 for i in range(150))
    assert sum(rows[2 * i + 1] >= len(p) / 2 for i, p in enumerate(passages)) >= 0.95 * 150
    check(docs_of(pairs), pairs)


def test_short_repeats_stay_and_passages_go(docs_of, prose):
    """A few common words repeat in many texts; only passages and whole copies are taken out."""
    common = "for the reason that was given above"
    clean = [(i, " ".join(f"{prose(100 * i + k, 12)} {common}" for k in range(6))) for i in range(1, 15)]
    passage = prose(7, 55)
    copies = [(20 + i, f"{prose(50 + i, 30)} {passage} {prose(70 + i, 30)}") for i in range(6)]
    short = [(40, "A short text that stands alone."), (41, "A short text that stands alone.")]
    rows = {r["doc_id"]: r["n_removed"] for r in chunks.dedupe_chunks(docs_of(clean + copies + short), keep_text=False).collect()}
    assert all(rows[i] == 0 for i, _ in clean)
    assert rows[20] == 0 and all(rows[20 + i] >= len(passage) / 2 for i in range(1, 6))
    assert rows[40] == 0 and rows[41] == len(short[1][1])
    check(docs_of(clean + copies + short), clean + copies + short)


def test_edge_cases(docs_of, prose):
    long = prose(5, 3000)
    pairs = [(1, None), (2, ""), (3, long), (4, long), (4, long), (5, "a" * 5000), (None, long[:900]), (None, None), (6, "short"), (6, prose(6, 30))]
    check(docs_of(pairs).repartition(4), pairs)
    assert chunks.dedupe_chunks(docs_of([])).collect() == []


def test_query_against_brute_force(spark):
    from tradewind.llm.queries import op2_chunks

    sf = "/root/testdata/sf0.001"
    pairs = [(r["doc_id"], r["text"]) for r in table(tune(spark), sf, "documents").collect()]
    want = brute(pairs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in op2_chunks(spark, sf).collect()}
    assert got == {i: want[i, t or ""] for i, t in pairs}
