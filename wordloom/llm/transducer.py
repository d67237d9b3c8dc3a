"""Operator 8: byte-pair encoding by a streaming transducer of bounded lookahead, and decoding by a state machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import bpe
from wordloom.llm.common import free_name, segments, sliced


@lru_cache(maxsize=4)
def sufficient_lookahead(vocabulary: str = bpe.VOCABULARY) -> int:
    """Bytes beyond a token boundary that can still undo it, at most; from the merge list alone.

    Bytes that arrive can break a merge only by one of lower rank that takes its right symbol; the left symbol is
    then free for a later merge with what stands before it, and so on. Such a chain of merges has rising ranks, each
    one's right symbol being the left symbol of the one before. The longest chain in bytes, over all ways in which
    two tokens join to a third, bounds how far the end of the input is felt.
    """
    ranks = bpe.load_ranks(vocabulary)
    reach: dict[bytes, int] = {}  # by left symbol: the bytes of the longest chain whose last merge has it
    longest = max(map(len, ranks), default=1)
    best = longest
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        found = []
        for k in range(1, len(token)):
            left, right = token[:k], token[k:]
            if left in ranks and right in ranks:
                found.append((left, k + max(reach.get(right, 0), len(right))))
        for left, size in found:
            if size > reach.get(left, 0):
                reach[left] = size
                best = max(best, size)
    return best + longest


def merge_symbols(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a short buffer: the lowest-rank adjacent pair joins, again and again, leftmost first."""
    n = len(piece)
    if piece in ranks or n < 2:
        return [piece]
    get = ranks.get
    big = 1 << 60
    cut = list(range(n + 1))
    rank = [get(piece[i : i + 2], big) for i in range(n - 1)]
    while rank:
        r = min(rank)
        if r == big:
            break
        i = rank.index(r)
        del cut[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = get(piece[cut[i] : cut[i + 2]], big)
        if i:
            rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], big)
    return [piece[a:b] for a, b in zip(cut, cut[1:])]


class Encoder:
    """Feeds on the bytes of a piece, in parts of any size; gives identifiers once no later byte can change them.

    The buffer holds at most the lookahead, one token and one step. A boundary that lies the lookahead or more
    before the buffer's end stands, and what follows it merges as if it began there.
    """

    STEP = 256

    def __init__(self, vocabulary: str = bpe.VOCABULARY):
        self.ranks = bpe.load_ranks(vocabulary)
        self.lookahead = sufficient_lookahead(vocabulary)
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for a in range(0, len(data), self.STEP):
            self.held += data[a : a + self.STEP]
            if len(self.held) >= self.lookahead + self.STEP:
                self._emit(out, len(self.held) - self.lookahead)
        return out

    def end(self) -> list[int]:
        out: list[int] = []
        self._emit(out, len(self.held))
        return out

    def _emit(self, out: list[int], stable: int) -> None:
        at = 0
        for t in merge_symbols(self.held, self.ranks) if self.held else ():
            if at + len(t) > stable:
                break
            at += len(t)
            out.append(self.ranks[t])
        self.held = self.held[at:]

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.STEP:
            return [self.ranks[t] for t in merge_symbols(data, self.ranks)] if data else []
        return self.feed(data) + self.end()


# A byte's kind, and from (state, kind) the next state: 0 between characters, 1..3 more bytes due, 4.. the tight
# second bytes after E0, ED, F0 and F4, 8 invalid.
_KIND = np.zeros(256, np.uint8)
for _a, _b, _k in ((0x80, 0x8F, 1), (0x90, 0x9F, 2), (0xA0, 0xBF, 3), (0xC0, 0xC1, 4), (0xC2, 0xDF, 5), (0xE0, 0xE0, 6), (0xE1, 0xEC, 7), (0xED, 0xED, 8), (0xEE, 0xEF, 7), (0xF0, 0xF0, 9), (0xF1, 0xF3, 10), (0xF4, 0xF4, 11), (0xF5, 0xFF, 4)):
    _KIND[_a : _b + 1] = _k
_NEXT = [[8] * 12 for _ in range(8)]
_NEXT[0][0] = 0
for _k, _s in ((5, 1), (6, 4), (7, 2), (8, 5), (9, 6), (10, 3), (11, 7)):
    _NEXT[0][_k] = _s
for _k in (1, 2, 3):
    _NEXT[1][_k], _NEXT[2][_k], _NEXT[3][_k] = 0, 1, 2
_NEXT[4][3] = 1
_NEXT[5][1] = _NEXT[5][2] = 1
_NEXT[6][2] = _NEXT[6][3] = 2
_NEXT[7][1] = 2


class Decoder:
    """Feeds on bytes in parts of any size; gives the text of all characters that are complete.

    Its state between parts is at most three bytes. What can't become a character gives U+FFFD, one for each
    longest part of a valid character.
    """

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data) - self._due(data)
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        last, self.tail = self.tail.decode("utf-8", "replace"), b""
        return last

    @staticmethod
    def _due(data: bytes) -> int:
        """Bytes at the end that begin a character which isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            if _KIND[data[-back]] >= 4:
                state = 0
                for b in data[-back:]:
                    state = _NEXT[state][_KIND[b]] if state < 8 else 8
                return back if 0 < state < 8 else 0
            if data[-back] < 0x80:
                return 0
        return 0


def decode_ids(parts: Iterable[np.ndarray], vocabulary: str = bpe.VOCABULARY) -> Iterator[str]:
    """The text of identifiers that arrive in parts, as it becomes complete."""
    flat, off = bpe.token_bytes(vocabulary)
    machine = Decoder()
    for ids in parts:
        yield machine.feed(bpe.gather(flat, off, np.asarray(ids, np.int64))[0].tobytes())
    yield machine.end()


_TABLE: tuple[str, bpe.Pieces] | None = None


def encode_texts(texts: list[str | None], vocabulary: str = bpe.VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers of all texts in order as int32, offsets by text)."""
    global _TABLE
    if _TABLE is None or _TABLE[0] != vocabulary:
        _TABLE = (vocabulary, bpe.Pieces(Encoder(vocabulary).piece))
    table, got, size = _TABLE[1], [], np.zeros(len(texts) + 1, np.int64)
    for rows, parts in segments(texts):
        ids, off = table.items(parts)
        got.append(ids)
        np.add.at(size, rows + 1, np.diff(off))
    return (np.concatenate(got) if got else np.zeros(0, np.int32)), np.cumsum(size)


def decode_rows(ids: np.ndarray, off: np.ndarray, vocabulary: str = bpe.VOCABULARY) -> list[str]:
    """The texts of rows of identifiers; each row passes through a machine of its own in bounded parts."""
    flat, at = bpe.token_bytes(vocabulary)
    out: list[str] = []
    step = 200_000
    k, n = 0, len(off) - 1
    while k < n:
        to = max(k + 1, int(np.searchsorted(off, off[k] + step, "right")) - 1)
        if off[to] - off[k] <= step:
            by, pos = bpe.gather(flat, at, ids[off[k] : off[to]])
            whole, pos = by.tobytes(), pos[off[k : to + 1] - off[k]].tolist()
            for a, b in zip(pos, pos[1:]):
                machine = Decoder()
                out.append(machine.feed(whole[a:b]) + machine.end())
        else:
            to = k + 1
            row = ids[off[k] : off[to]]
            out.append("".join(decode_ids((row[a : a + step] for a in range(0, len(row), step)), vocabulary)))
        k = to
    return out


def encode_documents(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens", match_col: str = "round_trip") -> DataFrame:
    """Every row with its columns, its identifiers (array of int), their number, and whether decoding gives the text back.

    One pass, no shuffle. A null text gives nulls, an empty one an empty array; repeated rows and null ids keep a
    row each; an empty table gives none. New columns that would clash with one of docs get a leading underscore.
    A very long text is handled in segments that end where pieces end; a very long piece streams through the
    transducer. Of pairs of equal rank the leftmost merges. A lone surrogate can't be UTF-8 and is encoded as "?".
    """
    names = [free_name(docs, c) for c in (ids_col, count_col, match_col)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text_col):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                ids, off = encode_texts(texts, vocabulary)
                back = decode_rows(ids, off, vocabulary)
                null = np.fromiter((t is None for t in texts), bool, len(texts))
                same = [a == b for a, b in zip(texts, back)]
                arr = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                more = [arr, pa.array(np.diff(off), mask=null), pa.array(same, pa.bool_(), mask=null)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])
            pa.default_memory_pool().release_unused()

    return docs.select(*(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(run, f"{schema}, `{names[0]}` array<int>, `{names[1]}` bigint, `{names[2]}` boolean")
