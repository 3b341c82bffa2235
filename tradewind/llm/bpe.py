"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 so that one pyahocorasick automaton over the vocabulary finds the longest token that starts
at a place. Encoding goes left to right and takes the longest match whose pair with the token
before is compatible, that is, merging by rank would produce these two neighbours; otherwise it tries shorter prefixes
and, when none is left, steps back. Every position is given up at most once, so time is linear in the piece. Whether
two tokens may stand side by side is remembered.

Edge cases: a null or empty text has no ids and decodes to nothing; equal texts give equal rows; extra columns are ignored.
A vocabulary token that merging cannot reach is used only where a whole piece equals it, as the rank files' library does.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tradewind.llm.common import by_value, map_arrow, worker_memory

by_value(__name__)

KEEP_PIECES = 400_000  # pieces remembered by a worker; the memory is emptied when full
KEEP_PAIRS = 2_000_000
MAX_VOCABULARY = 32_000_000  # bytes of a rank file that is sent to executors


def read_ranks(data: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


LATIN_END = 0x250  # below it a text is split by explicit character classes, which is several times as fast


def exact_pattern(pattern: str) -> str:
    """White space as the Unicode property, which is what the rank files' library means by it."""
    return (
        pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    )


def latin_pattern(pattern: str) -> str | None:
    """The same pattern for texts below LATIN_END, in plain classes; None if it uses other properties."""
    def members(property_: str) -> str:
        test = regex.compile(rf"\p{{{property_}}}").match
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if test(chr(c)))

    inside = {name: members(p) for name, p in (("L", "L"), ("N", "N"), ("s", "White_Space"))}
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{inside['s']}{inside['L']}{inside['N']}]")
    plain = plain.replace(r"\p{L}", f"[{inside['L']}]").replace(r"\p{N}", f"[{inside['N']}]")
    plain = plain.replace(r"\S", f"[^{inside['s']}]").replace(r"\s", f"[{inside['s']}]")
    return None if re.search(r"\\[pP]", plain) else plain


class Vocabulary:
    """Tables of a rank file, and encoding of one piece at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.any_text = regex.compile(exact_pattern(pattern)).findall
        latin = latin_pattern(pattern)
        self.latin_text = re.compile(latin).findall if latin else self.any_text
        self.beyond_latin = re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search
        self.most = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.digits = [str(i) for i in range(size)]
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * size
        self.compatible: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._build()

    def _build(self) -> None:
        ranks, reached = self.ranks, set()
        self.finder = ahocorasick.Automaton()
        for i, token in enumerate(self.bytes_of):
            if len(token) > 1:
                for cut in range(len(token) - 1, 0, -1):
                    head, tail = ranks.get(token[:cut], i), ranks.get(token[cut:], i)
                    if head in reached and tail in reached and self._fits(head, tail):
                        self.joined[head, tail] = i
                        self.halves[i] = (head, tail)
                        break
                else:
                    continue  # merging never makes this token
            if token:
                reached.add(i)
                self.finder.add_word(token.decode("latin-1"), i)
        self.finder.make_automaton()
        for i in reached:
            token = self.bytes_of[i]
            prefixes = (ranks.get(token[:end], -1) for end in range(len(token) - 1, 0, -1))
            self.shorter[i] = next((p for p in prefixes if p in reached), -1)
        self.compatible.clear()

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between these two tokens: undo their merges, latest first, and look
        for a merge across the border that would have come before."""
        limit = len(self.bytes_of)
        while self.joined.get((left, right), limit) >= limit:
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            atom_left, atom_right = inner_left == left, inner_right == right
            if atom_left and atom_right:
                return True
            # The later of the two merges is undone first; a single byte cannot be undone.
            if atom_right or (left > right and not atom_left):
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right
        return False

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= KEEP_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def longest(self, latin: str, at: int) -> int:
        """The longest token that starts at this place."""
        ahead = latin[at : at + self.most]
        for size in range(self.finder.longest_prefix(ahead), 0, -1):
            if (token := self.finder.get(ahead[:size], -1)) >= 0:
                return token
        return -1

    def split_text(self, text: str) -> list[str]:
        return self.any_text(text) if self.beyond_latin(text) else self.latin_text(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        latin = piece.decode("latin-1")
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, self.longest(latin, 0)
        lengths = self.bytes_of
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(lengths[token])
                if open_at[end] and (last < 0 or self.fits(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = self.longest(latin, at) if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary cannot spell this piece")
                open_at[at] = 0
                out.pop()
                at -= len(lengths[last])
                token = self.shorter[last]
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        if len(pieces) > KEEP_PIECES:
            pieces.clear()
        found = self.split_text(text)
        for piece in set(found).difference(pieces):
            pieces[piece] = tuple(self.encode_piece(piece.encode()))
        return list(chain.from_iterable(map(pieces.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """The tables of a rank file, built once in each Python worker."""
    built = worker_memory("vocabularies")
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in built:
        built[key] = Vocabulary(read_ranks(data), pattern)
    return built[key]


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError("rank file too large to send to executors")
    return data


def encode_documents(
    docs: DataFrame, path: str, pattern: str, carry: str = "doc_id", keep_ids: bool = True
) -> DataFrame:
    """Ids of every text, their digest, and the digest of the bytes that they decode to.

    One row per input row: the column named by `carry`, n_tokens, ids (if kept), ids_sha256, decoded_sha256.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batch: dict) -> dict:
        vocab = vocabulary(sent.value, pattern)
        out = {carry: batch[carry].to_pylist(), "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch["text"].to_pylist():
            ids = vocab.encode(text or "")
            out["n_tokens"].append(len(ids))
            out["ids"].append(ids if keep_ids else None)
            out["ids_sha256"].append(hashlib.sha256(",".join(map(vocab.digits.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(vocab.decode(ids)).hexdigest())
        return out

    kind = docs.schema[carry].dataType.simpleString()
    ids_column = "ids array<int>, " if keep_ids else ""
    schema = f"{carry} {kind}, n_tokens long, {ids_column}ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select(carry, "text"), schema, run)
