"""Operator 4: token counts by byte-pair merging with a heap and a linked list, emitting no identifiers."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm import bpe
from wordloom.llm.common import narrow, pylist, segments, sliced


def merge_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Merges that the vocabulary makes in one piece.

    The heap holds (rank, left symbol, end of right symbol) of adjacent pairs; an entry whose symbols have changed
    since is skipped. Symbols form a doubly linked list over byte positions.
    """
    n = len(piece)
    if n < 2:
        return 0
    heap = []
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    if not heap:
        return 0
    heapify(heap)
    end = list(range(1, n + 1))  # of the symbol that starts at i; 0 once it is part of its left neighbour
    before = list(range(-1, n))
    merges = 0
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        merges += 1
        end[i] = stop
        end[mid] = 0
        if stop < n:
            before[stop] = i
            e = end[stop]
            r = get(piece[i:e])
            if r is not None:
                heappush(heap, (r, i, e))
        p = before[i]
        if p >= 0:
            r = get(piece[p:stop])
            if r is not None:
                heappush(heap, (r, p, stop))
    return merges


def token_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row; one pass, no shuffle.

    Count = initial symbols (bytes) minus merges, summed over the pieces of the text; a worker merges each distinct
    piece once. A null text gives null, an empty one 0; repeated rows and null ids keep a row each; other columns,
    whatever their names, are not read; an empty table gives no rows. A very long text is handled in segments that
    end where pieces end, so that its count is exact and memory stays bounded. Of pairs of equal rank the leftmost merges.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _TABLE
        if _TABLE is None or _TABLE[0] != vocabulary:
            ranks = bpe.load_ranks(vocabulary)
            _TABLE = (vocabulary, bpe.Pieces(lambda b: (len(b) - merge_count(b, ranks),)))
        table = _TABLE[1]
        for batch in (part for whole in batches for part in sliced(whole, text_col)):
            texts = pylist(batch, text_col)
            count = np.zeros(len(texts), np.int64)
            for rows, parts in segments(texts):
                np.add.at(count, rows, table.sums(parts))
            null = np.fromiter((t is None for t in texts), bool, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, mask=null)], ["doc_id", "n_tokens"])

    return narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint")


_TABLE: tuple[str, bpe.Pieces] | None = None
