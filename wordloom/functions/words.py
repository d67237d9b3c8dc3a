"""Words of many texts at once, cut out of the texts' bytes: what WORD matches in each, without a regular expression.

Which characters belong to words is asked of the JVM once a session, so that both ways agree on every character.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]
_ASKED: dict[str, Ranges] = {}


def letters(spark: SparkSession) -> Ranges:
    """Code points that WORD takes for parts of words, as ranges [from, to)."""
    key = spark.sparkContext.applicationId
    if key not in _ASKED:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        some = spark.range(0, 0xD800).union(spark.range(0xE000, 0x110000))
        points = np.sort(np.array(some.where(char.rlike(r"^[\p{L}\p{N}_]$")).toArrow().column("id").to_numpy(), "int64"))
        starts = np.flatnonzero(np.r_[True, np.diff(points) > 1])
        _ASKED[key] = tuple((int(points[a]), int(points[b - 1]) + 1) for a, b in zip(starts, [*starts[1:], len(points)]))
    return _ASKED[key]


@cache
def _table(ranges: Ranges) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


def _inside(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8, whether its character belongs to words."""
    ascii_only = np.zeros(256, bool)
    ascii_only[:128] = table[:128]
    out = ascii_only[data]
    lead = np.flatnonzero(data >= 0xC0)
    for low, high, n, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        own = lead[(data[lead] >= low) & (data[lead] < high)]
        point = data[own].astype("int64") & mask
        for k in range(1, n):
            point = point << 6 | data[own + k] & 0x3F
        own = own[table[point]]
        for k in range(n):
            out[own + k] = True
    return out


def cut(texts: pa.Array, ranges: Ranges) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts one after the other, and how many each text has; a null has none."""
    texts = (texts if texts.null_count == 0 else pc.fill_null(texts, "")).cast("large_string")
    if not len(texts):
        return pa.array([], "string"), np.zeros(0, "int64")
    off = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[off[0] : off[-1]]
    off = off - off[0]
    word, first = _inside(data, _table(ranges)), np.zeros(len(data) + 1, bool)
    first[off] = True  # where a text begins, and where the last ends
    dots = np.flatnonzero(data == 0x2E)
    dots = dots[(dots > 0) & (dots < len(data) - 1)]
    dots = dots[word[dots - 1] & word[dots + 1] & ~first[dots] & ~first[dots + 1]]
    word[dots] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]][: len(word)] | first[:-1]))
    end = np.flatnonzero(word & (np.r_[~word[1:], True][: len(word)] | first[1:])) + 1
    sizes = np.diff(np.searchsorted(start, off))
    ends = np.r_[0, np.cumsum(end - start)].astype("int64")
    flat = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[word])])
    return flat, sizes


def allowed(terms: pa.Array, stoplist: list[str], minsize: int, maxsize: int | None) -> np.ndarray:
    """Which of some terms a stop filter keeps."""
    n = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
    ok = (n >= minsize) & (n <= maxsize if maxsize is not None else True)
    return ok & ~pc.is_in(terms, value_set=pa.array(stoplist, terms.type)).to_numpy(zero_copy_only=False)


def coded(texts: pa.Array, ranges: Ranges, stop: tuple | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the code of each token that a stop filter (stoplist, minsize, maxsize) keeps, how many each text has, and the
    place of the first of each text."""
    flat, raw = cut(texts, ranges)
    d = flat.dictionary_encode()
    terms, codes = d.dictionary.cast("string"), d.indices.to_numpy(zero_copy_only=False)
    if stop is None:
        return terms, codes, raw, np.zeros(len(raw), "int64")
    at = np.flatnonzero(allowed(terms, *stop)[codes]) if len(terms) else np.zeros(0, "int64")
    begin = np.r_[0, np.cumsum(raw)]
    edges = np.searchsorted(at, begin)
    sizes = np.diff(edges)
    first = np.where(sizes > 0, at[np.minimum(edges[:-1], max(0, len(at) - 1))] - begin[:-1], 0) if len(at) else np.zeros(len(raw), "int64")
    return terms, codes[at], sizes, first


def size(text: Column, ranges: Ranges, stop: tuple | None) -> Column:
    """How many tokens each text has."""

    @F.arrow_udf("int")
    def counted(x: pa.Array) -> pa.Array:
        flat, sizes = cut(x, ranges)
        if stop is not None:
            sizes = np.diff(np.r_[0, np.cumsum(allowed(flat, *stop))][np.r_[0, np.cumsum(sizes)]])
        return pa.array(sizes.astype("int32"))

    return counted(F.lower(text.cast("string")))


def strings(text: Column, ranges: Ranges, stop: tuple | None) -> Column:
    """array<string> of each text's tokens; a null has none."""

    @F.arrow_udf("array<string>")
    def taken(x: pa.Array) -> pa.Array:
        flat, sizes = cut(x, ranges)
        at = np.r_[0, np.cumsum(sizes)]
        if stop is not None:
            ok = allowed(flat, *stop)
            flat, at = flat.filter(pa.array(ok)), np.r_[0, np.cumsum(ok)][at]
        return pa.ListArray.from_arrays(pa.array(at.astype("int32")), flat.cast("string"))

    return taken(F.lower(text.cast("string")))
