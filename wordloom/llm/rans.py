"""Operator 2: token identifiers as binary blocks, by a static range asymmetric numeral system.

All blocks share one table of frequencies, counted over the whole corpus and scaled to 2**SCALE. A block holds up to
BLOCK identifiers, dealt to LANES interleaved states that share a stream of 32-bit words; blocks depend on nothing but
the table. Every STRIDE identifiers a checkpoint keeps the states, the place in the stream and a checksum of the
identifiers up to the next, so that parts of a block decode side by side, or alone, and are verified each. A checksum of
all identifiers goes with each block too, and one of the table with every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import bpe
from wordloom.llm.common import saved, segments, sliced

SCALE, LANES, BLOCK, STRIDE = 20, 128, 1 << 18, 1 << 16
LOW = np.uint64(1 << 31)
#: Identifiers that are encoded side by side.
AT_ONCE = 16 * BLOCK


@dataclass
class Table:
    freq: np.ndarray  # uint64 by identifier, of a sum of 2**SCALE
    start: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """Scaled frequencies: at least 1 for what occurs, the sum exact, remainders by size."""
        total = counts.sum()
        if not total:
            return Table(np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64))
        if (counts > 0).sum() > 1 << SCALE:
            raise ValueError("more identifiers occur than the scale has places")
        exact = counts * (float(1 << SCALE) / total)
        freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
        short = (1 << SCALE) - int(freq.sum())
        if short > 0:
            for i in np.argsort(-(exact - freq), kind="stable")[:short]:
                freq[i] += 1
            freq[int(freq.argmax())] += (1 << SCALE) - int(freq.sum())
        while short < 0:  # taken from the largest, which lose least by it
            big = np.argsort(-freq, kind="stable")[: max(1, min(-short, int((freq > 1).sum())))]
            cut = np.minimum(freq[big] - 1, max(1, -short // len(big)))
            cut = np.where(np.cumsum(cut) <= -short, cut, 0)
            freq[big] -= cut
            short = (1 << SCALE) - int(freq.sum())
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return Table(freq.astype(np.uint64), start.astype(np.uint64))

    def dump(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @staticmethod
    def load(data: bytes) -> Table:
        freq = np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint64)
        return Table(freq, np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64))

    @property
    def checksum(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode(table: Table, ids: np.ndarray, at: np.ndarray) -> list[tuple[bytes, list[tuple[int, int, bytes]]]]:
    """For each block ids[at[i]:at[i + 1]]: its words, and checkpoints (identifier, word, states) by place."""
    n = np.diff(at)
    blocks = len(n)
    lane = np.arange(LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words, owner = [], []
    emitted = np.zeros(blocks, np.int64)
    points: list[list[tuple[int, int, bytes]]] = [[] for _ in range(blocks)]
    freq, start = table.freq[ids], table.start[ids]
    limit = np.uint64((1 << 31 >> SCALE) << 32)
    steps = -(-n // LANES)
    last = int(steps.max(initial=0))
    base = (at[:-1, None] + lane).ravel()
    shortest = int(n.min(initial=0))
    for t in range(last - 1, -1, -1):
        whole = (t + 1) * LANES <= shortest
        if whole:
            p = base + t * LANES
        else:
            live = t * LANES + lane[None, :] < n[:, None]
            p = (base + t * LANES)[live.ravel()]
        f, c = freq[p], start[p]
        s = x[live] if not whole else x.ravel()
        over = s >= limit * f
        k = np.flatnonzero(over)
        if len(k):
            who = k // LANES if whole else np.repeat(np.arange(blocks), live.sum(1))[k]
            words.append((s[k] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[::-1])
            owner.append(who[::-1])
            emitted += np.bincount(who, minlength=blocks)
            s[k] >>= np.uint64(32)
        q = s // f
        s = (q << np.uint64(SCALE)) + (s - q * f) + c
        if whole:
            x = s.reshape(blocks, LANES)
        else:
            x[live] = s
        if t * LANES % STRIDE == 0:
            for b in np.flatnonzero(n > t * LANES).tolist():
                points[b].append((t * LANES, int(emitted[b]), x[b].astype("<u8").tobytes()))
    flat = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    who = np.concatenate(owner)[::-1] if owner else np.zeros(0, np.int64)
    flat = flat[np.argsort(who, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(emitted)])
    # until now a checkpoint knows the words that follow it
    return [(flat[upto[b] : upto[b + 1]].astype("<u4").tobytes(), [(i, int(emitted[b]) - w, s) for i, w, s in reversed(points[b])]) for b in range(blocks)]


_SLOTS: dict[int, np.ndarray] = {}


def _slots(table: Table) -> np.ndarray:
    slots = _SLOTS.get(table.checksum)
    if slots is None:
        _SLOTS.clear()
        slots = _SLOTS[table.checksum] = np.repeat(np.arange(len(table.freq)), table.freq.astype(np.int64))
    return slots


def decode(table: Table, payload: bytes, points: list[tuple[int, int, bytes]], stops: list[int]) -> list[np.ndarray]:
    """Identifiers of each part of a block, from its checkpoint (identifier, word, states) to its stop; all parts advance at once."""
    slots, words = _slots(table), np.frombuffer(payload, "<u4")
    size = np.array([stop - p[0] for p, stop in zip(points, stops)], np.int64)
    word = np.array([p[1] for p in points], np.int64)
    x = np.stack([np.frombuffer(p[2], "<u8").astype(np.uint64) for p in points]) if points else np.zeros((0, LANES), np.uint64)
    longest = -(-int(size.max(initial=0)) // LANES) * LANES
    out = np.zeros((len(points), longest), np.int32)
    mask, lane = np.uint64((1 << SCALE) - 1), np.arange(LANES)
    for t in range(0, longest, LANES):
        live = t + lane[None, :] < size[:, None]
        low = x & mask
        s = slots[low.astype(np.int64)]
        out[:, t : t + LANES] = s
        y = table.freq[s] * (x >> np.uint64(SCALE)) + low - table.start[s]
        need = live & (y < LOW)
        if need.any():
            place = word[:, None] + np.cumsum(need, axis=1) - 1
            y[need] = (y[need] << np.uint64(32)) | words[place[need]]
            word += need.sum(axis=1)
        x = np.where(live, y, x)
    return [row[:n] for row, n in zip(out, size.tolist())]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def decode_block(table: Table, row: dict, parts: range | None = None) -> np.ndarray:
    """Identifiers of a block's row, or of the given parts of it alone, with every checksum held against them."""
    if row["table_crc"] != table.checksum:
        raise ValueError("the block belongs to another table")
    points = row["checkpoints"]
    stops = [p["first"] for p in points[1:]] + [row["n_tokens"]]
    chosen = range(len(points)) if parts is None else parts
    made = decode(table, row["payload"], [(points[k]["first"], points[k]["word"], points[k]["states"]) for k in chosen], [stops[k] for k in chosen])
    if any(_crc(ids) != points[k]["crc"] for k, ids in zip(chosen, made)):
        raise ValueError("a part of the block doesn't decode to what was encoded")
    ids = np.concatenate(made) if made else np.zeros(0, np.int32)
    if parts is None and _crc(ids) != row["token_crc"]:
        raise ValueError("the block doesn't decode to what was encoded")
    return ids


_TABLE: tuple[str, bpe.Pieces] | None = None


def _encode_ids(texts: list[str | None], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    global _TABLE
    if _TABLE is None or _TABLE[0] != vocabulary:
        _TABLE = (vocabulary, bpe.library_pieces(vocabulary))
    got, size = [], np.zeros(len(texts) + 1, np.int64)
    for rows, parts in segments(texts):
        ids, off = _TABLE[1].items(parts)
        got.append(ids)
        np.add.at(size, rows + 1, np.diff(off))
    return (np.concatenate(got) if got else np.zeros(0, np.int32)), np.cumsum(size)


def _tokens(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, null_text, counts): identifiers as bytes, and at the end of each task a row with its counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    vocab = max(bpe.load_ranks(vocabulary).values()) + 1
    width = "<u2" if vocab <= 1 << 16 else "<u4"
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(vocab, np.int64)
        id_type = None
        for b in (part for whole in batches for part in sliced(whole, text_col)):
            texts = b.column(1).to_pylist()
            id_type = b.schema.field(0).type
            ids, off = _encode_ids(texts, vocabulary)
            count += np.bincount(ids, minlength=vocab)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((off * size).astype(np.int32)), pa.py_buffer(ids.astype(width))])
            yield pa.RecordBatch.from_arrays([b.column(0), data, b.column(1).is_null(), pa.nulls(len(texts), pa.binary())], ["doc_id", "ids", "null_text", "counts"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([count.tobytes()], pa.binary())], ["doc_id", "ids", "null_text", "counts"])

    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(run, f"doc_id {kind}, ids binary, null_text boolean, counts binary")


def frequencies(tokens: DataFrame, vocab: int) -> Table:
    """The table over all tasks' counts; they are added up by identifier on the executors."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                c = np.frombuffer(data, np.int64)
                i = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(c[i])], ["id", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(unpack, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table.of(counts)


def _layout(size: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Blocks of (row, part, identifiers): whole rows while they fit; a row longer than a block fills several."""
    out: list[list[tuple[int, int, int]]] = []
    block: list[tuple[int, int, int]] = []
    held = 0
    for i, n in enumerate(size.tolist()):
        if block and held + n > BLOCK:
            out.append(block)
            block, held = [], 0
        part = 0
        while n > BLOCK:
            out.append([(i, part, BLOCK)])
            n -= BLOCK
            part += 1
        block.append((i, part, n))
        held += n
    if block:
        out.append(block)
    return out


def encode_documents(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block (block_id, doc_ids, parts, counts, n_tokens, payload, checkpoints, token_crc, table_crc), and one,
    of block_id -1, whose payload is the table.

    doc_ids, parts and counts run in step: of that document's part (0 unless it fills several blocks) so many identifiers
    stand here. A null text has a null count, an empty one 0; repeated rows and null ids keep an entry each; other columns
    are not read; an empty table gives the table's row alone, with no frequencies; identifiers of equal counts have equal
    frequencies but for the remainders, which go to the smaller ones first. The texts are read once, whole: their
    identifiers wait in the shared folder for the table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = saved(_tokens(docs, vocabulary, id_col, text_col))
    vocab = max(bpe.load_ranks(vocabulary).values()) + 1
    table = frequencies(tokens, vocab)
    width = "<u2" if vocab <= 1 << 16 else "<u4"
    points = pa.list_(pa.struct([("first", pa.int32()), ("word", pa.int32()), ("states", pa.binary()), ("crc", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        crc = table.checksum
        for b in (part for whole in batches for part in sliced(whole, "ids", 8_000_000)):
            col = b.column(1)
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            ids = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(width).astype(np.int64)
            size = np.diff(off) // np.dtype(width).itemsize
            names, null = b.column(0), b.column(2).to_pylist()
            layout = _layout(size)
            at = np.concatenate([[0], np.cumsum([sum(n for _, _, n in x) for x in layout])]).astype(np.int64)
            k = 0
            while k < len(layout):
                to = max(k + 1, int(np.searchsorted(at, at[k] + AT_ONCE, "right")) - 1)
                part = ids[at[k] : at[to]]
                made = encode(table, part, at[k : to + 1] - at[k])
                chosen = layout[k:to]
                lists = lambda j, t: pa.array([[x[j] for x in block] for block in chosen], pa.list_(t))
                flat = pa.array([x[0] for block in chosen for x in block], pa.int64())
                edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in chosen])]).astype(np.int32))
                counts = pa.array([[None if null[i] else n for i, _, n in block] for block in chosen], pa.list_(pa.int32()))
                owns = [part[a:z] for a, z in zip(at[k:to] - at[k], at[k + 1 : to + 1] - at[k])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([task + number + i for i in range(len(chosen))], pa.int64()), pa.ListArray.from_arrays(edges, names.take(flat)), lists(1, pa.int32()), counts,
                    pa.array(np.diff(at[k : to + 1]).astype(np.int32)), pa.array([m[0] for m in made], pa.binary()),
                    pa.array([[{"first": i, "word": w, "states": s, "crc": _crc(own[i : i + STRIDE])} for i, w, s in m[1]] for m, own in zip(made, owns)], points), pa.array([_crc(own) for own in owns], pa.int64()), pa.array([crc] * len(chosen), pa.int64()),
                ], NAMES)
                number += len(chosen)
                k = to

    schema = f"block_id bigint, doc_ids array<{kind}>, parts array<int>, counts array<int>, n_tokens int, payload binary, checkpoints array<struct<first:int,word:int,states:binary,crc:bigint>>, token_crc bigint, table_crc bigint"
    blocks = tokens.where("counts is null").select("doc_id", "ids", "null_text").mapInArrow(run, schema)
    head = spark.createDataFrame([(-1, [], [], [], 0, bytearray(table.dump()), [], 0, table.checksum)], schema)
    return head.unionByName(blocks)


NAMES = ["block_id", "doc_ids", "parts", "counts", "n_tokens", "payload", "checkpoints", "token_crc", "table_crc"]


def decode_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, part, token_ids) of blocks as encode_documents gives them; token_ids is null where the text was.

    Every entry of a block has a row: null ids and repeated rows too, an empty text with an empty list; of a very long text
    each part is a row, to be joined in the order of part; blocks decode by themselves, in any order and on any executor;
    blocks' other columns are not read; the table's row alone gives none, and without it there is nothing to decode with.
    """
    table = Table.load(bytes(blocks.where("block_id = -1").select("payload").first()[0]))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, at = decode_block(table, row), 0
                lists = []
                for n in row["counts"]:
                    lists.append(None if n is None else ids[at : at + n].tolist())
                    at += n or 0
                names = b.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], names), pa.array(row["parts"], pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "part", "token_ids"])

    return blocks.where("block_id >= 0").mapInArrow(run, f"doc_id {kind}, part int, token_ids array<int>")
