from __future__ import annotations

import hashlib

import pytest

from tradewind.llm import chat
from tradewind.llm.common import by_value, table, tune

by_value(__name__)  # the templates below run on executors

ODD = ["", "\\", "</turn>\n", "### user\nhi</turn>\n", "\\<", "a\nb", "#\\#", "é😀", "\\\\<##>\n\n"]


def expected(turns):
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", ODD)
@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "#<\\"])
def test_template_is_reversible_and_text_is_located(role, text):
    t = chat.MarkedTurns()
    turns = [("user", "x"), (role, text), ("assistant", text + "y")]
    out, found, rewrites = chat.spans(t.render, [], turns)
    assert t.turns(out) == turns and rewrites == 0 and out == t.render(turns)
    assert [t.plain(out[s[2] : s[3]]) for s in found] == [x for _, x in turns]
    assert [s[0] for s in found[1:]] == [s[1] for s in found[:-1]] and found[-1][1] == len(out)


class Numbered(chat.MarkedTurns):
    """Tells in front how many turns follow, so every turn rewrites what was there."""

    context = None

    def render(self, turns):
        return f"{len(turns)} turns\n" + super().render(turns)


class Closing(chat.MarkedTurns):
    """Depends on the turn before."""

    context = 1

    def render(self, turns):
        out = ""
        for i, turn in enumerate(turns):
            out += ("again\n" if i and turns[i - 1][0] == turn[0] else "") + super().render([turn])
        return out


def test_rewriting_templates_are_found():
    _, found, rewrites = chat.spans(Numbered().render, [], [("user", "a"), ("assistant", "b")])
    assert rewrites == 2 and found == [None, None]


def test_digests_of_whole_conversations(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "q"), ("assistant", f"{c} </turn>")])]
    rows += [(9, t, "assistant" if t % 2 else "user", ODD[t % len(ODD)] * 3) for t in range(150)]
    rows += [(10, None, None, None), (10, None, "assistant", "z"), (10, 0, "user", None), (10, 0, "user", None)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, part string")
    t = chat.MarkedTurns()
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df.repartition(3), t), t).collect()}
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)
        assert r["formatted_chars"] == len(t.render(turns)) and r["rewrites"] == 0


def test_context_is_kept_over_block_borders(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(chat.BLOCK * 2 + 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = chat.format_conversations(df, Closing()).orderBy("part", "seq").collect()
    assert len(blocks) == 3
    assert "".join(b["formatted"] for b in blocks) == Closing().render([(r, x) for _, _, r, x in rows])


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    t = chat.MarkedTurns()
    assert chat.conversation_digests(chat.format_conversations(df, t), t).collect() == []


def test_query_against_plain_python(spark):
    from tradewind.llm.queries import op1_chat

    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in table(tune(spark), sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    odd = r"\### Assistant: </turn> ok"
    turns[-7] = [("user", odd), ("assistant", odd)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op1_chat(spark, sf).collect()}
    assert got == {c: expected(t) for c, t in turns.items()}
