from __future__ import annotations

import pytest

from tradewind.llm import lines


def brute(pairs):
    """(doc_id, text) -> what is left of it and the number of lines that went."""
    rows = sorted({(i is None, i or 0, t) for i, t in pairs if t is not None})
    seen, out = {}, {}
    for unknown, i, text in rows:
        split, gone = text.split("\n"), set()
        for at, two in enumerate(zip(split, split[1:], strict=False)):
            if len(two[0]) + len(two[1]) >= lines.LEAST_CHARS and seen.setdefault(two, (unknown, i, text, at)) != (unknown, i, text, at):
                gone |= {at, at + 1}
        out[None if unknown else i, text] = ("\n".join(x for at, x in enumerate(split) if at not in gone), len(gone))
    return out


def check(df, pairs):
    got = [(r["doc_id"], r["text"], r["removed_lines"]) for r in lines.drop_repeated_lines(df).collect()]
    want = brute(pairs)
    expected = [(i, *(want[i, t] if t is not None else (None, 0))) for i, t in pairs]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def paragraph(seed, n):
    return "\n".join(f"line {seed} {k} of some length" for k in range(n))


def test_chunks_resist_an_inserted_line(docs_of):
    a = paragraph(1, 60)
    b = a.replace("line 1 30", "new line\nline 1 30")
    found = {r["doc_id"]: sorted(r["places"]) for r in lines.chunks(docs_of([(1, a), (2, b)])).collect()}
    # The inserted line parts one chunk in two and leaves the other pairs of lines as they were.
    assert found[1] == [i for i in range(59) if i != 29] and found[2] == [i for i in range(60) if i not in (29, 30)]


@pytest.mark.parametrize("n", range(2, 9))
def test_every_line_of_a_shared_passage_goes(docs_of, n):
    """Passages of two to eight lines at the front, in the middle and at the end of texts."""
    pairs, want = [], {}
    for k in range(6):
        shared = paragraph(100 + k, n)
        before, after = paragraph(10 * k + 1, k % 3), paragraph(10 * k + 2, 2 + k % 2)
        texts = [f"{paragraph(10 * k + 3, 3)}\n{shared}\n{paragraph(10 * k + 4, 4)}", "\n".join(x for x in (before, shared, after) if x)]
        for j, text in enumerate(texts):
            pairs.append((2 * k + j, text))
            want[2 * k + j] = j * n
    check(docs_of(pairs).repartition(3), pairs)
    assert {r["doc_id"]: r["removed_lines"] for r in lines.drop_repeated_lines(docs_of(pairs)).collect()} == want


def test_overlapping_passages_and_single_lines(docs_of):
    a, b, c, d = (f"a sentence of the text number {k}" for k in range(4))
    pairs = [
        (1, "\n".join([a, b, c])), (2, "\n".join([b, c, d])), (3, "\n".join([c, d, a])), (4, "\n".join([d, "other words in between", b])),
        (5, "\n".join([a, a, a, a])), (6, "}\n}\n" + a + "\n}\n}"), (7, "}\n}\n" + b + "\n}\n}"),
    ]
    check(docs_of(pairs), pairs)
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs_of(pairs)).collect()}
    assert got[2] == d and got[3] == a and got[4] == pairs[3][1] and got[5] == a and got[6] == pairs[5][1] and got[7] == pairs[6][1]


def test_edge_cases(docs_of):
    long = paragraph(5, 3000)
    pairs = [
        (1, None), (2, ""), (3, "\n\n\n\n"), (4, "\n\n\n\n"), (5, "B\nB\nL\nLB\nB"), (6, "B\nB\nL\nLB\nB"), (7, long), (8, long), (14, "\n".join(["ä" * 10, "ö" * 10])), (15, "\n".join(["ä" * 10, "ö" * 10, ""])),
        (8, long), (8, paragraph(5, 40)), (None, paragraph(5, 40)), (None, None), (9, "one line"), (10, "one line"),
        (11, "é\r\nä\r\n$1\\n\n"), (12, "é\r\nä\r\n$1\\n\n"), (13, "a\n"),
    ]
    check(docs_of(pairs).repartition(3), pairs)
    assert lines.drop_repeated_lines(docs_of([])).collect() == []


def test_other_columns_pass_and_names_may_clash(docs_of):
    df = docs_of([(1, paragraph(1, 9)), (2, paragraph(1, 9))]).selectExpr("*", "1 AS _hash", "2 AS _removed", "3 AS seq", "4 AS hash")
    got = lines.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "removed_lines"]
    assert {(r["_hash"], r["_removed"], r["seq"], r["hash"], r["lang"]) for r in got.collect()} == {(1, 2, 3, 4, "en")}
    with pytest.raises(ValueError, match="removed_lines"):
        lines.drop_repeated_lines(got)


def test_plan_has_no_python(docs_of):
    plan = lines.drop_repeated_lines(docs_of([(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
