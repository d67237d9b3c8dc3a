"""Byte-pair encoding on public vocabularies: vectorised pre-tokenisation, and tables of pieces seen before.

Texts are split as the byte-level vocabularies expect (contractions, letters, digits, other signs, white space),
for all texts of a chunk at once. A worker then handles each distinct piece once; what it learned is kept in a
table of at most TABLE_ROWS pieces, found by 64-bit hashes and held against the pieces themselves, sign by sign.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from wordloom.llm.common import LETTER, SPACE, char_classes, code_points, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker's table holds before it starts anew; bounds memory, changes no result.
TABLE_ROWS = 800_000
#: And signs of pieces that it holds.
TABLE_SIGNS = 8_000_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes joined, offsets by identifier); identifiers that the file lacks are empty."""
    ranks = load_ranks(path)
    by = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, i in ranks.items():
        by[i] = t
    off = np.zeros(len(by) + 1, np.int64)
    np.cumsum([len(t) for t in by], out=off[1:])
    return np.frombuffer(b"".join(by), np.uint8), off


def piece_starts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start in the joined texts; at: the texts' bounds."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    c = char_classes()[cp]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(c[1:], c[:-1], out=run[1:])
    first = np.zeros(n + 1, bool)
    first[at] = True
    first = first[:n]
    run |= first
    space = c == SPACE
    solid = run & ~space
    after = np.zeros(n, bool)  # something else than white space right after white space
    after[1:] = solid[1:] & space[:-1] & ~first[1:]
    glued = after.copy()
    glued[1:] &= cp[:-1] == 32
    start = run & ~glued
    start[:-1] |= after[1:]
    # 's 't 're 've 'm 'll 'd where the sign stands alone and has no blank of its own
    p = np.flatnonzero(cp == 39)
    p = p[p + 1 < n]
    if len(p):
        p = p[solid[p] & ~glued[p] & run[p + 1] & ~first[p + 1] & (c[p + 1] == LETTER)]
        a = cp[p + 1]
        end = p + 2 < n
        q = np.minimum(p + 2, n - 1)
        b = np.where(end & (c[q] == LETTER) & ~run[q], cp[q], 0)
        one = np.isin(a, [115, 116, 109, 100])
        two = ~one & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
        p, size = p[one | two], np.where(one[one | two], 2, 3)
        start[p + 1] = False
        q = p + size
        q = q[q < n]
        q = q[(c[q] == LETTER) & ~run[q]]
        start[q] = True
    return np.flatnonzero(start)


class Pieces:
    """What make() gives for each distinct piece (its bytes), as ragged int32 rows, for whole chunks at once."""

    def __init__(self, make: Callable[[bytes], list[int] | tuple[int, ...]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.odd: dict[str, int] = {}  # pieces whose hash another piece has taken
        self.flat = array("i")
        self.off = array("q", [0])
        self.cp = np.zeros(1 << 16, np.uint32)  # the pieces of all slots joined
        self.cp_off = array("q", [0])

    def _add(self, piece: str) -> int:
        self.flat.extend(self.make(piece.encode("utf-8", "replace")))
        self.off.append(len(self.flat))
        return len(self.off) - 2

    def _keep(self, pieces: list[np.ndarray]) -> None:
        """Append the code points of new slots."""
        end = self.cp_off[-1]
        for p in pieces:
            self.cp_off.append(self.cp_off[-1] + len(p))
        if self.cp_off[-1] > len(self.cp):
            more = np.zeros(max(2 * len(self.cp), self.cp_off[-1]), np.uint32)
            more[:end] = self.cp[:end]
            self.cp = more
        if pieces:
            self.cp[end : self.cp_off[-1]] = np.concatenate(pieces)

    def _others(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Which pieces differ from the piece of the slot that their hash led to."""
        size = ends - starts
        at = np.array(self.cp_off, np.int64)
        other = at[to + 1] - at[to] != size
        where = np.repeat(np.where(other, 0, at[to] - starts), size) + np.arange(len(cp))
        unlike = self.cp[np.minimum(where, len(self.cp) - 1)] != cp
        other[~other] = np.logical_or.reduceat(unlike, starts)[~other]
        return np.flatnonzero(other)

    def rows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot of each piece, first piece of each text, with one more at the end, offsets of slots)."""
        cp, at = code_points(parts)
        starts = piece_starts(cp, at)
        ends = np.append(starts[1:], len(cp))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.asarray(self.off, np.int64)
        uniq, inv = np.unique(span_hashes(cp, starts, ends), return_inverse=True)
        if len(self.slot) + len(self.odd) + len(uniq) > TABLE_ROWS or self.cp_off[-1] > TABLE_SIGNS:
            self.clear()
        slot = self.slot
        hashes = uniq.tolist()
        to = np.array([slot.get(h, -1) for h in hashes], np.int64)
        new = np.flatnonzero(to < 0)
        text = ""
        if len(new):
            where = np.zeros(len(uniq), np.int64)
            where[inv] = np.arange(len(inv))
            w = where[new]
            text = "".join(parts)
            for k, a, b in zip(new.tolist(), starts[w].tolist(), ends[w].tolist()):
                to[k] = slot[hashes[k]] = self._add(text[a:b])
            self._keep([cp[a:b] for a, b in zip(starts[w].tolist(), ends[w].tolist())])
        to = to[inv]
        odd = self._others(cp, starts, ends, to)
        if len(odd):
            text = text or "".join(parts)
            for k in odd.tolist():
                piece = text[starts[k] : ends[k]]
                if piece not in self.odd:
                    self.odd[piece] = self._add(piece)
                    self._keep([cp[starts[k] : ends[k]]])
                to[k] = self.odd[piece]
        return to, np.searchsorted(starts, at, "left"), np.array(self.off, np.int64)

    def sizes(self, parts: list[str]) -> np.ndarray:
        """Items of each text in all."""
        slots, first, off = self.rows(parts)
        total = np.zeros(len(slots) + 1, np.int64)
        np.cumsum((off[1:] - off[:-1])[slots], out=total[1:])
        return total[first[1:]] - total[first[:-1]]

    def sums(self, parts: list[str]) -> np.ndarray:
        """The sum of each text's items; make gives one item a piece."""
        slots, first, _ = self.rows(parts)
        total = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(np.array(self.flat, np.int64)[slots], out=total[1:])
        return total[first[1:]] - total[first[:-1]]

    def items(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all items of the texts in order, offsets by text)."""
        slots, first, off = self.rows(parts)
        size = (off[1:] - off[:-1])[slots]
        upto = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        out = flat[np.repeat(off[slots] - upto[:-1], size) + np.arange(upto[-1])]
        return out, upto[first]


def gather(flat: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ids of a ragged array joined, and the offsets of each."""
    size = (off[1:] - off[:-1])[ids]
    upto = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    return flat[np.repeat(off[ids] - upto[:-1], size) + np.arange(upto[-1])], upto


def library_pieces(path: str) -> Pieces:
    """Identifiers of pieces by the installed library, for operators whose method isn't the merging itself."""
    import tiktoken

    enc = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})
    return Pieces(enc._core_bpe.encode_single_piece)

