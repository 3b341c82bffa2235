"""Chat formatting with a black-box template: only what it renders is looked at.

The template renders longer and longer prefixes of a conversation. What each output adds to the one before is the new
turn's span; rendering the turn once more without its text shows where in the span the text lies. A template whose
output for k turns does not start its output for k + 1 turns rewrites history: such turns are counted, and spans that a
rewrite touched are given up (null).

A template says how many turns before a turn its output depends on (`context`; None: all). Conversations are cut into
blocks of `BLOCK` turns, so prefixes stay short; with context 0 the blocks of one conversation may lie in different
tasks, otherwise its turns are read in order by one task, a block at a time.

Edge cases: a null role or text is empty; turns are ordered by (turn, role, text), nulls first, and repeated rows are
turns of their own; rows without a conv_id form one conversation; extra columns are ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradewind.llm.common import by_value

by_value(__name__)

BLOCK = 32
Turn = tuple[str, str]


class MarkedTurns:
    """`### role`, the text, `</turn>`. Inside, a backslash goes before each backslash, `<` and `#`, and in a role also
    before a line break, so no text can look like a mark."""

    context: int | None = 0
    _turn = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)

    def render(self, turns: Sequence[Turn]) -> str:
        return "".join(
            f"### {re.sub(r'([\\<#\n])', r'\\\1', role)}\n{re.sub(r'([\\<#])', r'\\\1', text)}</turn>\n" for role, text in turns
        )

    def plain(self, escaped: str) -> str:
        return re.sub(r"\\(.)", r"\1", escaped, flags=re.DOTALL)

    def turns(self, output: str) -> list[Turn]:
        """The turns read back from an output."""
        out, at = [], 0
        while at < len(output):
            m = self._turn.match(output, at)
            if not m:
                raise ValueError("this is not an output of the template")
            out.append((self.plain(m[1]), self.plain(m[2])))
            at = m.end()
        return out


def shared_start(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def shared_end(a: str, b: str, most: int) -> int:
    """Length of the common ending, `most` at most."""
    return len(os.path.commonprefix((a[::-1][:most], b[::-1][:most])))


def spans(
    render: Callable[[Sequence[Turn]], str], lead: Sequence[Turn], turns: Sequence[Turn]
) -> tuple[str, list[tuple[int, int, int, int] | None], int]:
    """What `turns` add after `lead`; (start, end, text start, text end) of each in it, None where history was rewritten;
    and how many turns rewrote history."""
    shown = list(lead)
    before = render(shown)
    base = len(before)
    found: list[tuple[int, int, int, int] | None] = []
    rewrites = 0
    for role, text in turns:
        without = render([*shown, (role, "")])
        shown.append((role, text))
        after = render(shown)
        same = len(before) if after.startswith(before) else shared_start(before, after)
        if same < len(before):
            rewrites += 1
            found = [s if s and s[1] + base <= same else None for s in found]
            found.append(None)
        else:
            first = shared_start(without, after)
            last = len(after) - shared_end(without, after, min(len(without), len(after)) - first)
            found.append((same - base, len(after) - base, max(same, first) - base, last - base))
        before = after
    return before[base:], found, rewrites


FORMATTED = (
    "part int, seq long, n_turns long, rewrites long, formatted string,"
    " spans array<struct<role string, start int, end int, text_start int, text_end int>>"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(conversations: DataFrame, template) -> DataFrame:
    """Blocks of formatted turns: conv_id, part and seq (their order), n_turns, rewrites, formatted, spans.

    Positions in `spans` count from the start of the block. Joined in order, a conversation's blocks are its output.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order) if template.context == 0 else rows.repartition("conv_id")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(FORMATTED).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ready = TaskContext.get().partitionId(), 0, []

        def block(conv, lead, turns):
            text, found, rewrites = spans(template.render, lead, turns)
            places = [
                {"role": r, **dict(zip(("start", "end", "text_start", "text_end"), s or (None,) * 4, strict=True))}
                for (r, _), s in zip(turns, found, strict=True)
            ]
            return conv, part, seq, len(turns), rewrites, text, places

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), arrow, strict=True)], schema=arrow
            )

        now, lead, turns = None, [], []
        most = BLOCK if template.context is not None else float("inf")
        for conv, _, role, text in _rows(batches):
            if turns and (conv != now or len(turns) >= most):
                ready.append(block(now, lead, turns))
                seq += 1
                lead = (lead + turns)[-template.context:] if template.context and conv == now else []
                turns = []
            if conv != now:
                lead = []
            now = conv
            turns.append((role, text))
            if len(ready) >= 64:
                yield out()
                ready.clear()
        if turns:
            ready.append(block(now, lead, turns))
        if ready:
            yield out()

    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)


def conversation_digests(blocks: DataFrame, template, loss_role: str = "assistant") -> DataFrame:
    """Per conversation, read back from the formatted blocks: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites. Blocks arrive in order and only running digests are held."""
    kind = blocks.schema["conv_id"]
    schema = T.StructType([kind, *T.StructType.fromDDL(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    ).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, state = [], None

        def done():
            conv, n, turns, chars, loss, formatted, rewrites = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, rewrites

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), arrow, strict=True)], schema=arrow
            )

        for conv, _, _, rewrites, formatted, places in _rows(batches):
            if state is None or conv != state[0]:
                if state:
                    ready.append(done())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in template.turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for s in places:
                if s["role"] == loss_role and s["start"] is not None:
                    text = template.plain(formatted[s["text_start"]: s["text_end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
            state[5] += len(formatted)
            state[6] += rewrites
            if len(ready) >= 1024:
                yield out()
                ready.clear()
        if state:
            ready.append(done())
        if ready:
            yield out()

    rows = blocks.select("conv_id", "part", "seq", "rewrites", "formatted", "spans")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)
