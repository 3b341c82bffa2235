"""SentencePiece encoding and decoding by vectorised merge rounds.

The library merges, over a whole text, the adjacent pair whose joined piece scores highest, the leftmost first. Here a text is cut
into words that no piece of the model can span, and the distinct words of a batch that are not remembered yet lie one after
another in flat arrays: a symbol and the pair that starts there with its rank. A round finds the least rank of each word
(segmented minimum), merges its occurrences from the left, and compacts the arrays, until no pair is left. Remembered words have
numbers, their ids lie in one array, and the ids of a batch are gathered from it at once.

Merging all occurrences at once equals merging one by one as long as no new pair ranks as low as the one just merged.
Where one does, only the leftmost is merged in this round. Pairs are looked up for that only beside pieces of which the model has such a
pair at all.

Long words are cut into segments of SEGMENT symbols (64 to 127 each at the start), and a segment merges when its least rank is not
above its neighbours': a chain of merges that starts further away would have to swallow a whole segment with one piece, and no
piece is that long. Segments of equal rank go together as far as all before them are safe in the sense above. So the rounds depend
on the text's local shape and not on the length of a word. A run of blanks is cut at every longest piece of blanks, if
that piece comes about from the left, all such pieces share the lowest score, and no piece has several blanks and a letter.

Symbols without a piece become byte pieces. Decoding joins pieces, turns runs of byte pieces into text (a bad byte into
U+FFFD) and drops the blank that encoding puts first. Control pieces give nothing.

Edge cases. Null and empty texts have the end id alone. Texts of any length are encoded whole. Repeated rows give equal rows; an
empty table gives none. Models that are not BPE with byte fallback and identity normalisation are refused, also those
with user-defined or unused pieces. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import DataFrame

from tradewind.llm.common import by_value, map_arrow, worker_memory

by_value(__name__)

SEGMENT = 64
KEEP_WORDS, KEEP_CHARS = 300_000, 6_000_000
MAX_MODEL = 64 << 20
NEVER = np.iinfo(np.int32).max
BLANK = "▁"

# Fixed values of the model file: field numbers and piece types.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, BPE, SUFFIX_BLANKS, BYTE_FALLBACK, UNKNOWN_ID, END_ID, UNKNOWN_SURFACE = 3, 2, 24, 35, 40, 42, 44
NORMALIZER_NAME, CHARSMAP, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 2, 3, 4, 5


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Numbers(dict):
    """Word -> its number, in the order in which words come; `fresh` has those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        self.fresh.append(word)
        return found


def joins_whole(sizes: set[int], widest: int) -> bool:
    """Whether `widest` blanks, joined pair by pair from the left, end as one piece; further blanks then change nothing."""
    run = [1] * widest
    while at := next((i for i in range(1, len(run)) if run[i - 1] + run[i] in sizes), 0):
        run[at - 1 : at + 1] = [run[at - 1] + run[at]]
    return len(run) == 1


class PieceModel:
    """Tables of one model: pair ranks for encoding, surfaces for decoding, and remembered words."""

    def __init__(self, data: bytes):
        pieces, settings = [], {TRAINER: {}, NORMALIZER: {}}
        for number, value in fields(data):
            if number == PIECE:
                f = dict(fields(value))
                pieces.append((f[PIECE_TEXT].decode(), struct.unpack("<f", f.get(PIECE_SCORE, bytes(4)))[0], f.get(PIECE_TYPE, NORMAL)))
            elif number in settings:
                settings[number] = dict(fields(value))
        trainer, normalizer = settings[TRAINER], settings[NORMALIZER]
        plain = (
            trainer.get(MODEL_TYPE) == BPE
            and trainer.get(BYTE_FALLBACK)
            and not trainer.get(SUFFIX_BLANKS)
            and not normalizer.get(CHARSMAP)
            and normalizer.get(DUMMY_PREFIX, 1)
            and not normalizer.get(EXTRA_BLANKS, 1)
            and normalizer.get(ESCAPE_BLANKS, 1)
            and {kind for _, _, kind in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        )
        if not plain:
            raise ValueError("only BPE models with byte fallback and identity normalisation are encoded here")
        self.end = trainer.get(END_ID, 2)
        self.kinds = [kind for _, _, kind in pieces]
        self.texts = [text for text, _, _ in pieces]
        self.bytes_at = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.digits = list(map(str, range(len(pieces))))
        unknown = trainer.get(UNKNOWN_SURFACE, b" \xe2\x81\x87 ")
        self.surfaces = [self._surface(t, kind, unknown) for t, _, kind in pieces]
        self._pairs({t: (i, score) for i, (t, score, kind) in enumerate(pieces) if kind == NORMAL})
        self._forget()

    def _forget(self) -> None:
        """No word is remembered any more."""
        self.words, self.chars = Numbers(), 0
        self.kept, self.starts, self.counts = (np.empty(0, np.int64) for _ in range(3))

    @staticmethod
    def _surface(text: str, kind: int, unknown: bytes) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: unknown}.get(kind, text.replace(BLANK, " ").encode())

    def _pairs(self, known: dict[str, tuple[int, float]]) -> None:
        """Symbols are pieces by id, then characters that only longer pieces hold. Every way to halve a piece is a pair."""
        if (longest := max(map(len, known))) * 2 > SEGMENT:
            raise ValueError("pieces are too long for the segments")
        symbols = {text: i for text, (i, _) in known.items()}
        for character in sorted(set("".join(known)) - symbols.keys()):
            symbols[character] = len(self.texts) + len(symbols)
        self.symbols = max(symbols.values(), default=0) + 2
        self.first = np.full(0x110000, self.symbols - 1, np.int64)  # the last symbol has no piece and no pair
        for text, i in symbols.items():
            if len(text) == 1:
                self.first[ord(text)] = i
        order = {score: rank for rank, score in enumerate(sorted({s for _, s in known.values()}, reverse=True))}
        pairs = {}
        for text, (i, score) in known.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left * self.symbols + right] = (order[score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.joined = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # Slots of a hash table for the pairs, at most an eighth full; a pair lies at its slot or soon after it.
        self.shift = np.uint64(64 - max(4, len(pairs)).bit_length() - 3)
        self.slots = np.full((1 << (64 - int(self.shift))) + len(pairs) + 1, -1, np.int32)
        for at, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = at
        # Pieces that some pair holds which ranks as low as the piece itself.
        self.early = np.zeros(self.symbols, bool)
        own = np.full(self.symbols, -1, np.int64)
        own[[i for i, _ in known.values()]] = [order[score] for _, score in known.values()]
        for side in (self.keys // self.symbols, self.keys % self.symbols):
            self.early[side[self.ranks <= own[side]]] = True
        # Words end before a blank, if no piece goes on from another character to a blank.
        spans = any(BLANK in text.lstrip(BLANK) for text in known)
        self.word = re.compile(".+" if spans else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", re.DOTALL)
        runs = {len(text): score for text, (_, score) in known.items() if set(text) == {BLANK}}
        widest = max(runs, default=0)
        above = [score for text, (_, score) in known.items() if set(text) != {BLANK}]
        whole = (
            widest > 1
            and not spans
            and len(lowest := {score for n, score in runs.items() if n > 1}) == 1
            and min(above) > max(lowest)
            and not any(text.startswith(BLANK * 2) and set(text) != {BLANK} for text in known)
            and joins_whole(set(runs), widest)
        )
        self.run = re.compile(f"{BLANK}{{{widest}}}(?={BLANK})") if whole else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables, -1 if the two do not join."""
        wanted = left * self.symbols + right
        slot = self._slot(wanted)
        at = self.slots[slot]
        open_ = np.flatnonzero(at >= 0)
        open_ = open_[self.keys[at[open_]] != wanted[open_]]
        while open_.size:
            slot[open_] += 1
            at[open_] = found = self.slots[slot[open_]]
            open_ = open_[found >= 0]
            open_ = open_[self.keys[at[open_]] != wanted[open_]]
        return at

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.lookup(left, right)
        return np.where(at < 0, NEVER, self.ranks[at]) if len(self.ranks) else np.full(len(at), NEVER, np.int32)

    def split(self, text: str) -> list[str]:
        """The words of a text; joined they give the text with its first blank and all blanks as pieces write them."""
        if not text:
            return []
        marked = BLANK + text.replace(" ", BLANK)
        words = self.word.findall(marked)
        if self.run and self.run.search(marked):
            words = list(chain.from_iterable(map(self._cut_run, words)))
        return words

    def _cut_run(self, word: str) -> list[str]:
        """Full pieces of blanks at the start of a word are words of their own, but for the last blank."""
        out, at = [], 0
        while found := self.run.match(word, at):
            out.append(found.group())
            at = found.end()
        return [*out, word[at:]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words, one word after another, and how many each has; all words are merged together, round by round."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol, origin = self.first[codes], np.arange(len(codes), dtype=np.int32)
        # Segments never change owner: a symbol belongs to the segment in which it starts.
        per_word = np.maximum(sizes // SEGMENT, 1)
        owner = np.repeat(np.arange(len(words)), per_word)
        if len(owner) == len(words):
            segment = np.repeat(np.arange(len(words)), sizes)
        else:
            inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            part = np.minimum(inside // SEGMENT, np.repeat(per_word, sizes) - 1)
            segment = np.repeat(np.cumsum(per_word) - per_word, sizes) + part
        ended_at: list[tuple[np.ndarray, np.ndarray]] = []
        pair, rank, touched = np.full(symbol.size, -1, np.int32), np.full(symbol.size, NEVER, np.int32), np.arange(symbol.size)
        while symbol.size:
            # Only pairs beside a merge have a new rank.
            pair[touched], rank[touched] = -1, NEVER
            inner = touched[touched < symbol.size - 1]
            inner = inner[owner[segment[inner]] == owner[segment[inner + 1]]]
            at = self.lookup(symbol[inner], symbol[inner + 1])
            inner, at = inner[at >= 0], at[at >= 0]
            pair[inner], rank[inner] = at, self.ranks[at]
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            active = segment[starts]
            least = np.full(len(owner), NEVER, np.int32)
            least[active] = np.minimum.reduceat(rank, starts)
            merge = self._merges(symbol, pair, rank, segment, owner, least)
            symbol[merge] = self.joined[pair[merge]]
            stay = np.ones(symbol.size, bool)
            stay[merge + 1] = False
            # Words without a pair left are put aside.
            alive = np.zeros(len(words), bool)
            alive[owner[least < NEVER]] = True
            ended = ~alive[owner][segment]
            if ended.any():
                ended_at.append((origin[ended], symbol[ended]))
                stay &= ~ended
            touched = np.zeros(symbol.size, bool)
            touched[merge] = True
            symbol, origin, segment, pair, rank, touched = (x[stay] for x in (symbol, origin, segment, pair, rank, touched))
            touched[:-1] |= touched[1:].copy()
            touched = np.flatnonzero(touched)
        return self._ids(ended_at, codes, sizes)

    def _merges(self, symbol, pair, rank, segment, owner, least) -> np.ndarray:
        """Places of the left halves of the pairs that merge in this round."""
        n = len(owner)
        before, after = np.full(n, NEVER, np.int32), np.full(n, NEVER, np.int32)
        same = owner[1:] == owner[:-1]
        before[1:][same], after[:-1][same] = least[:-1][same], least[1:][same]
        wanted = np.flatnonzero((rank < NEVER) & (rank == least[segment]))
        if not wanted.size:
            return wanted
        # From the left without overlap: every second one of consecutive candidates of one rank.
        gap = np.concatenate([[True], (np.diff(wanted) > 1) | (np.diff(rank[wanted]) != 0)])
        run_start = np.maximum.accumulate(np.where(gap, np.arange(wanted.size), 0))
        chosen = wanted[(np.arange(wanted.size) - run_start) % 2 == 0]
        own = segment[chosen]
        made = self.joined[pair[chosen]]
        unsafe = np.zeros(n, bool)
        early = np.flatnonzero(self.early[made])
        if early.size:
            # Ranks of the pairs that these merges make, as the one-by-one order would meet them.
            left = symbol[np.maximum(chosen - 1, 0)].copy()
            follows = np.concatenate([[False], np.diff(chosen) == 2])
            left[follows] = made[:-1][follows[1:]]
            at, piece, of = chosen[early], made[early], owner[own[early]]
            has_left = (at > 0) & (owner[segment[np.maximum(at - 1, 0)]] == of)
            right_at = np.minimum(at + 2, symbol.size - 1)
            has_right = (at + 2 < symbol.size) & (owner[segment[right_at]] == of)
            new = np.minimum(
                np.where(has_left, self.rank(left[early], piece), NEVER), np.where(has_right, self.rank(piece, symbol[right_at]), NEVER)
            )
            unsafe[own[early][new <= least[own[early]]]] = True
        # A segment may act if no neighbour comes first; of neighbours with one rank, those up to the first that may not or
        # is not safe.
        may = (least < NEVER) & (before >= least) & (after >= least)
        chained = np.concatenate([[False], same & (least[1:] == least[:-1]) & (least[1:] < NEVER)])
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
        bad = np.cumsum(~may | unsafe)
        bad_before = np.concatenate([[0], bad[:-1]])
        acts = may & (bad_before - bad_before[head] == 0) & ~(unsafe & chained)
        first = np.concatenate([[True], own[1:] != own[:-1]])
        return chosen[acts[own] & (first | ~unsafe[own])]

    def _ids(self, ended, codes, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Symbols in text order as ids, symbols without a piece as the bytes of their character; the number of ids of each word."""
        found = np.full(len(codes), -1, np.int64)
        for origin, symbol in ended:
            found[origin] = symbol
        each = (found >= 0).astype(np.int64)
        bare = np.flatnonzero(found >= len(self.texts))
        as_bytes = [[self.bytes_at[b] for b in chr(codes[i]).encode()] for i in bare.tolist()]
        each[bare] = [len(x) for x in as_bytes]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = np.repeat(found, each)
        for at, x in zip(ends[bare].tolist(), as_bytes, strict=True):
            ids[at : at + len(x)] = x
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def _learn(self) -> None:
        """Encode the words that have come since the last time, and remember their ids by number."""
        fresh, self.words.fresh = self.words.fresh, []
        try:
            ids, counts = self.encode_words(fresh)
        except BaseException:
            self._forget()  # their numbers would have no ids
            raise
        self.chars += sum(map(len, fresh))
        at = len(self.kept) + np.cumsum(counts) - counts
        self.kept, self.starts, self.counts = (
            np.concatenate(x) for x in ((self.kept, ids), (self.starts, at), (self.counts, counts))
        )

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the end id; new words of all texts are merged in the same rounds."""
        if len(self.words) > KEEP_WORDS or self.chars > KEEP_CHARS:
            self._forget()
        split = [self.split(t) for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        if self.words.fresh:
            self._learn()
        counts = self.counts[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.kept[np.repeat(self.starts[number] - ends[:-1], counts) + np.arange(ends[-1])].tolist()
        ends = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [[*ids[a:b], self.end] for a, b in pairwise(ends)]

    def decode(self, ids: list[int]) -> str:
        blank = self._leads_with_blank(ids)
        joined = b"".join(map(self.surfaces.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = "".join(self._surface_runs(ids))
        return text[1:] if blank else text

    def _leads_with_blank(self, ids: list[int]) -> bool:
        for i in ids:
            if self.kinds[i] != CONTROL:
                return self.kinds[i] == NORMAL and self.texts[i].startswith(BLANK)
        return False

    def _surface_runs(self, ids: list[int]) -> Iterator[str]:
        """Surfaces piece by piece; a byte of a run that starts no character is U+FFFD alone."""
        run = b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.surfaces[i]
                continue
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        yield run[at : at + size].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    yield "�"
                at += size
            run = b""
            if i is not None:
                yield self.surfaces[i].decode()


def piece_model(data: bytes) -> PieceModel:
    """The tables of a model file, built once in each Python worker."""
    built = worker_memory("piece models")
    key = hashlib.sha256(data).hexdigest()
    if key not in built:
        built[key] = PieceModel(data)
    return built[key]


def model_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL + 1)
    if len(data) > MAX_MODEL:
        raise ValueError("model file too large to send to executors")
    return data


def encode_pieces(docs: DataFrame, path: str, carry: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Ids of every text with the end id, their digest, and the digest of the text that they decode to.

    One row per input row: the column named by `carry`, n_tokens, ids (if kept), ids_sha256, decoded_sha256.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model_file(path))

    def run(batch: dict) -> dict:
        model = piece_model(sent.value)
        found = model.encode_batch([t or "" for t in batch["text"].to_pylist()])
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return {
            carry: batch[carry].to_pylist(),
            "n_tokens": [len(ids) for ids in found],
            "ids": found if keep_ids else [],
            "ids_sha256": [sha(" ".join(map(model.digits.__getitem__, ids))) for ids in found],
            "decoded_sha256": [sha(model.decode(ids)) for ids in found],
        }

    kind = docs.schema[carry].dataType.simpleString()
    ids_column = "ids array<int>, " if keep_ids else ""
    schema = f"{carry} {kind}, n_tokens long, {ids_column}ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select(carry, "text"), schema, run)
