"""Postings of a table of documents, drawn together by term in blocks and dealt to partitions by ranges of terms, in one pass
over the texts.

A block is a row of one term and many documents: (term, doc_ids, boost, weights[, positions]), whose lists are bytes of
numbers (see LISTS), which Spark moves as they are: a row's columns of varying length are what moving it costs. A document's
number, count and length lie together in doc_ids; weights is null where a weight is tf * boost, and positions has tf numbers a
document. What is shuffled and sorted are blocks, of which there are as many as a batch of documents has different terms. A range partitioning of Spark's own works its input out twice, once for a sample. Here a sample of documents
gives the bounds (it decides about sizes alone), and each batch's terms are held against the bounds once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import words
from wordloom.functions.formats import FieldType

#: Documents of the sample, postings that a partition is to have, tokens that are drawn together at once.
SAMPLED, PART_ROWS, AT_ONCE = 1000, 1_000_000, 4_000_000
#: Entries that a sketch has for each partition, about.
SKETCHED = 16
#: The numbers in a block's lists, low byte first.
LISTS = {"doc_ids": np.dtype([("doc_id", "<i8"), ("tf", "<i4"), ("length", "<i4")]), "weights": np.dtype("<f8"), "positions": np.dtype("<i4")}
#: Rows of postings that go from Python to Spark at once.
ROWS_AT_ONCE = 200_000
#: Postings that a block made of several has at most, but for blocks that had more before.
BLOCK_ROWS = 50_000


def sampled(docs: DataFrame, n: int) -> DataFrame:
    return docs if n <= SAMPLED else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n // SAMPLED)) == 0)


def sketch_of(docs: DataFrame, field: str, kind: FieldType) -> list[tuple[str, int]]:
    """Terms in order, and how many postings lie after the one before and up to each, about, by a sample of documents."""
    n = docs.count()
    strings = kind.analyzer.strings(F.col(field))
    return sketch(sampled(docs, n).select(F.explode(F.array_distinct(kind.analyzer.terms(F.col(field)) if strings is None else strings)).alias("t")).withColumn("c", F.lit(1)), n)


def sketch(terms: DataFrame, n: int) -> list[tuple[str, int]]:
    """sketch_of() from the terms (t) of the sample of n documents, and how many of it have them (c)."""
    scale = max(1, n // SAMPLED)
    return merged([sorted((r.t, r.c * scale) for r in terms.groupBy("t").agg(F.sum("c").alias("c")).collect())])


def merged(sketches: list[list[tuple[str, int]]], scale: float = 1.0) -> list[tuple[str, int]]:
    """One sketch of several; scale: the share of the postings that is left."""
    out, seen, told = [], 0.0, 0
    for t, c in sorted((t, c) for own in sketches for t, c in own):
        seen += c * scale
        if seen - told >= PART_ROWS / SKETCHED:
            out.append((t, round(seen) - told))
            told = round(seen)
        last = t
    return out if round(seen) == told else [*out, (last, round(seen) - told)]


def bounds(sketch: list[tuple[str, int]]) -> list[str]:
    """Terms between which the partitions lie; a term that fills several stands as often."""
    total = sum(c for _, c in sketch)
    parts = -(-total // PART_ROWS)
    out, seen = [], 0
    for t, c in sketch:
        seen += c
        out += [t] * (seen * parts // total - len(out))
    return out[: max(0, parts - 1)]


def bounds_of(docs: DataFrame, field: str, kind: FieldType) -> list[str]:
    return bounds(sketch_of(docs, field, kind))


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of AT_ONCE tokens at most, of one document at least."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, to
        at = to


def _parts(terms: pa.Array, some: np.ndarray, bounds: list[str]) -> pa.Array:
    """The partition of each block, sorted by term; of a term that fills several, some (a number a block) says which."""
    n = len(terms)
    if not n:
        return pa.array([], "int32")
    below = bisect_left(bounds, terms[0].as_py())
    within = bounds[below : bisect_right(bounds, terms[n - 1].as_py())]
    often = Counter(within)
    own = {b: (_after(terms, b, False), _after(terms, b, True)) for b in often}
    low = below + np.cumsum(np.bincount(np.array([own[b][1] for b in within], "int64"), minlength=n + 1))[:n]
    for b, k in often.items():
        at = slice(*own[b])  # low counts bounds below a term: the term itself isn't one
        low[at] += some[at] % (k + 1)
    return pa.array(low.astype("int32"))


def _after(terms: pa.Array, t: str, own: bool) -> int:
    """How many of sorted terms lie before t, or before and at it."""
    low, high = 0, len(terms)
    while low < high:
        mid = (low + high) // 2
        x = terms[mid].as_py()
        if x < t or own and x == t:
            low = mid + 1
        else:
            high = mid
    return low


def _edges(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]][: len(key)])


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 up, by digits."""
    order = np.argsort(key.astype("uint16"), kind="stable")
    for shift in range(16, int(key.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((key >> shift).astype("uint16")[order], kind="stable")]
    return order


def _bytes(name: str, at: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of a block's column that lie between positions at of all their values; nulls if there are none."""
    kind = LISTS[name]
    if not len(values):
        return pa.nulls(len(at) - 1, pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * kind.itemsize).astype("int32")), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _numbers(name: str, c: pa.Array, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What _bytes was given."""
    kind, c = np.dtype(kind or LISTS[name]), c.cast(pa.binary())
    if not len(c):
        return np.zeros(1, "int64"), np.zeros(0, kind)
    off = np.frombuffer(c.buffers()[1], "int32")[c.offset : c.offset + len(c) + 1].astype("int64")
    data = np.frombuffer(c.buffers()[2] or b"", "uint8")[off[0] : off[-1]]
    return (off - off[0]) // kind.itemsize, np.frombuffer(data, kind)


def _records(ids: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), LISTS["doc_ids"])
    out["doc_id"], out["tf"], out["length"] = ids, tf, length
    return out


def drawn(ids: np.ndarray, terms: pa.Array, codes: np.ndarray, sizes: np.ndarray, pos: np.ndarray, b: np.ndarray | None, bounds: list[str], boost: float, positions: bool) -> pa.RecordBatch:
    """Blocks of documents, sorted by term: codes has the term of each token, sizes the tokens of each document, pos and b
    their places and boosts (None: 1)."""
    ranked = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(terms), "int32")
    rank[ranked] = np.arange(len(terms))
    term, doc = rank[codes], np.repeat(np.arange(len(ids), dtype="int32"), sizes)
    order = _order(term) if b is None else np.lexsort((pos, doc, term))  # without boosts, tokens come by place
    term, doc = term[order], doc[order]
    start = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])][: len(term)])
    tf = np.diff(np.r_[start, len(term)])
    owner, term = doc[start], term[start]
    block = _edges(term)
    at = np.r_[block, len(start)]
    weights = np.zeros(0) if b is None or not len(start) else np.add.reduceat(b[order], start) * boost
    named = terms.take(pa.array(ranked[term[block]]))
    columns = {
        "part": _parts(named, ids[owner[block]], bounds), "term": named, "doc_ids": _bytes("doc_ids", at, _records(ids[owner], tf, sizes[owner])),
        "boost": pa.array(np.full(len(block), boost, "float64")), "weights": _bytes("weights", at, weights),
    }
    if positions:
        columns["positions"] = _bytes("positions", np.r_[start, len(order)][at], pos[order])
    return pa.RecordBatch.from_pydict(columns)


def _columns(positions: bool) -> str:
    return "term string, doc_ids binary, boost double, weights binary" + ", positions binary" * positions


def blocks(docs: DataFrame, field: str, kind: FieldType, bounds: list[str]) -> DataFrame:
    """(part, term, ...) of every document."""
    boost, positions, plain = float(kind.field_boost), kind.positions, kind.analyzer.plain()
    numbered = kind.analyzer.numbered(F.col(field))
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    if plain is not None:
        rows, (stop,), ranges = docs.select(ids, F.lower(F.col(field).cast("string")).alias("x")), plain, words.letters(docs.sparkSession)
    elif numbered is not None:
        rows = docs.select(ids, numbered.alias("n")).select("doc_id", "n.x", "n.first")
    else:
        rows = docs.select(ids, kind.analyzer.tokens(F.col(field)).alias("x"))
    cut, structs = plain is not None, numbered is None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            # words are guessed from bytes, as they aren't cut yet
            most = (pc.fill_null(pc.binary_length(x), 0) if cut else pc.list_value_length(x)).to_numpy(zero_copy_only=False)
            for at, to in _slices(most // 6 if cut else most):
                part = batch.slice(at, to - at)
                x, b = part.column("x"), None
                if cut:
                    terms, codes, sizes, first = words.coded(x, ranges, stop)
                else:
                    sizes, flat = np.diff(x.offsets.to_numpy()), x.flatten()
                    coded = (flat.field("t") if structs else flat).dictionary_encode()
                    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                    first = None if structs else part.column("first").to_numpy()
                if first is None:
                    pos, b = flat.field("pos").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)
                else:
                    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
                yield drawn(part.column("doc_id").to_numpy(), terms, codes, sizes, pos, b, bounds, boost, positions)

    return rows.mapInArrow(run, "part int, " + _columns(positions))


def dealt(blocks: DataFrame, bounds: list[str]) -> DataFrame:
    """Blocks in partitions by ranges of terms."""
    return blocks.repartitionById(len(bounds) + 1, F.col("part")).drop("part")


def _row_columns(positions: bool) -> str:
    return "term string, doc_id bigint, tf int, weight double, length int" + ", positions array<int>" * positions


def opened(blocks: DataFrame, positions: bool) -> DataFrame:
    """(term, doc_id, tf, weight, length[, positions]) of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, docs = _numbers("doc_ids", batch.column("doc_ids"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            tf = np.ascontiguousarray(docs["tf"])
            weight = tf * batch.column("boost").to_numpy()[row]
            own, given = _numbers("weights", batch.column("weights"))
            weight[(np.diff(own) > 0)[row]] = given
            made = [batch.column("term").take(pa.array(row)), pa.array(np.ascontiguousarray(docs["doc_id"])), pa.array(tf), pa.array(weight), pa.array(np.ascontiguousarray(docs["length"]))]
            if positions:
                made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf)].astype("int32")), pa.array(_numbers("positions", batch.column("positions"))[1])))
            rows = pa.RecordBatch.from_arrays(made, names=["term", "doc_id", "tf", "weight", "length", "positions"][: len(made)])
            for k in range(0, rows.num_rows, ROWS_AT_ONCE):
                yield rows.slice(k, ROWS_AT_ONCE)

    return _packed(blocks).select("term", "doc_ids", "boost", "weights", *(["positions"] if positions else [])).mapInArrow(run, _row_columns(positions))


def _packed(blocks: DataFrame) -> DataFrame:
    """Blocks of version 2, whose numbers, counts and lengths are lists of their own, as they are now."""
    if "tfs" not in blocks.columns:
        return blocks
    left = [c for c in blocks.columns if c not in ("tfs", "lengths")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids = _numbers("", batch.column("doc_ids"), "<i8")
            docs = _records(ids, *(_numbers("", batch.column(c), "<i4")[1] for c in ("tfs", "lengths")))
            yield pa.RecordBatch.from_pydict({c: _bytes(c, at, docs) if c == "doc_ids" else batch.column(c) for c in left})

    return blocks.mapInArrow(run, blocks.select(*left).schema)


def closed(rows: DataFrame, positions: bool) -> DataFrame:
    """Blocks of one posting each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, np.arange(batch.num_rows + 1)
            made = {"term": batch.column("term"), "doc_ids": _bytes("doc_ids", at, _records(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tf", "length"))))}
            made |= {"boost": pa.array(np.ones(n)), "weights": _bytes("weights", at, batch.column("weight").to_numpy(zero_copy_only=False))}
            if positions:
                sizes = pc.list_value_length(batch.column("positions")).to_numpy(zero_copy_only=False)
                made["positions"] = _bytes("positions", np.r_[0, np.cumsum(sizes)], batch.column("positions").flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict(made)

    return rows.mapInArrow(run, _columns(positions))


def sample_of(blocks: DataFrame, n: int) -> DataFrame:
    """(t, c): terms of the blocks' postings of a sample of documents, of n in all, for sketch()."""
    step = max(1, n // SAMPLED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, docs = _numbers("doc_ids", batch.column("doc_ids"))
            taken = (docs["doc_id"].astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(step) == 0
            c = np.diff(np.r_[0, np.cumsum(taken)][at])
            yield pa.RecordBatch.from_pydict({"t": batch.column("term"), "c": pa.array(c.astype("int64"))}).filter(pa.array(c > 0))

    return _packed(blocks).select("term", "doc_ids").mapInArrow(run, "t string, c bigint")


def by_ranges(docs: DataFrame, field: str, kind: FieldType) -> DataFrame:
    """(term, doc_id, tf, weight, length[, positions]) of every document, in partitions by ranges of terms."""
    between = bounds_of(docs, field, kind)
    return opened(dealt(blocks(docs, field, kind, between), between), kind.positions)


def _kept(batch: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
    """Blocks without some documents (sorted)."""
    at, docs = _numbers("doc_ids", batch.column("doc_ids"))
    ids = docs["doc_id"]
    stay = gone[np.minimum(np.searchsorted(gone, ids), len(gone) - 1)] != ids
    if stay.all():
        return batch
    out = {name: batch.column(name) for name in batch.schema.names}
    for name in (x for x in LISTS if x in out):
        own, values = _numbers(name, out[name])
        if name == "weights":
            left = stay[np.repeat(np.diff(own) > 0, np.diff(at))]
        else:
            left = np.repeat(stay, docs["tf"]) if name == "positions" else stay
        out[name] = _bytes(name, np.r_[0, np.cumsum(left)][own], values[left])
    return pa.RecordBatch.from_pydict(out).filter(pc.greater(pc.fill_null(pc.binary_length(out["doc_ids"]), 0), 0))


def without(blocks: DataFrame, gone: np.ndarray, bounds: list[str]) -> DataFrame:
    """(part, term, ...) of blocks, sorted by term, without some documents (sorted)."""
    blocks = _packed(blocks)
    schema = "part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch may have the end of one file and the beginning of another
            for left in _sorted(_kept(batch, gone) if len(gone) and batch.num_rows else batch):
                at, docs = _numbers("doc_ids", left.column("doc_ids"))
                yield pa.RecordBatch.from_arrays([_parts(left.column("term"), docs["doc_id"][at[:-1]], bounds), *left.columns], names=["part", *left.schema.names])

    return blocks.mapInArrow(run, schema)


def _sorted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The runs of a batch that are sorted by term."""
    term = batch.column("term")
    falls = np.flatnonzero(pc.less(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(term) else ()
    for a, b in zip([0, *falls], [*falls, len(term)]):
        if b > a:
            yield batch.slice(a, b - a)


def joined(blocks: DataFrame) -> DataFrame:
    """Neighbouring blocks of a term and boost as one: only the lists' bounds between them are dropped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            term = batch.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = _numbers("doc_ids", batch.column("doc_ids"))[0]
            weighted = np.diff(_numbers("weights", batch.column("weights"))[0]) > 0
            apart = (np.diff(term) != 0) | (np.diff(at[1:] // BLOCK_ROWS) != 0) | (np.diff(batch.column("boost").to_numpy()) != 0) | (weighted[1:] != weighted[:-1])
            new = np.flatnonzero(np.r_[True, apart])
            out = {}
            for name in batch.schema.names:
                c = batch.column(name)
                if name in LISTS:
                    own, values = _numbers(name, c)
                    out[name] = _bytes(name, np.r_[own[new], own[-1]], values)
                else:
                    out[name] = c.take(pa.array(new))
            yield pa.RecordBatch.from_pydict(out)

    return blocks.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields))


