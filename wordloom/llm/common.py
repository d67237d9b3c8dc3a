"""What the corpus operators share: the shared folder, key columns, and texts cut into bounded batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step handles; bounds a Python worker's memory whatever the batch.
CHUNK_CHARS = 400_000

_WRITTEN: dict[int, list[tuple[SparkSession, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, a local master gets one of its own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the session may be gone already; the folder is the cluster's to clear
        pass


def saved(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wordloom-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    _WRITTEN.setdefault(id(spark.sparkContext), []).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete what saved() wrote for dfs, once nothing that is still to run reads it."""
    for df in dfs:
        if path := getattr(df, "_saved_at", None):
            _drop(df.sparkSession, path)


@atexit.register
def drop_all() -> None:
    """Delete all that saved() has written. A long session calls it when the results so far have been written or read."""
    for written in _WRITTEN.values():
        for spark, path in written:
            _drop(spark, path)
    _WRITTEN.clear()


def bounded_sample(df: DataFrame, most: int, by: Column, total: int | None = None) -> DataFrame:
    """At most `most` rows of df, chosen by the hash `by`. A share of the hashes is cut off first, so that no task keeps
    many more rows than its part of the sample."""
    total = df.count() if total is None else total
    if total > most:
        share = min(1.0, 1.1 * most / total + 20 / total)
        df = df.where(F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30)))
    return df.orderBy(by, *df.columns).limit(most)


def shared_hashes(one: DataFrame) -> DataFrame:
    """(h1, keep): first hashes that several of one's rows (h1, h2) have, and the second hash of the row that keeps it as its name."""
    return saved(one.groupBy("h1").agg(F.min("h2").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "keep"))


def with_vertex(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (h1, h2, ...) with the bigint id of their content: h1, or a hash of both where another content keeps h1."""
    named = rows.join(shared, "h1", "left")
    return named.withColumn("id", F.when(F.col("keep").isNull() | (F.col("keep") == F.col("h2")), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))).drop("keep")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator needs, so that others can't clash with its own."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def segments(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Batches of (row index of each segment, segments) of about limit characters.

    A longer text is cut before white space that follows something else, where every tokenisation here has a
    boundary; one without any is taken whole. Nulls count as empty texts.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while at < len(t):
            stop = len(t)
            if stop - at > limit:
                stop = _cut_at(t, at + limit)
            rows.append(i)
            parts.append(t if at == 0 and stop == len(t) else t[at:stop])
            held += stop - at
            at = stop
            if held >= limit:
                yield np.array(rows, np.int64), parts
                rows, parts, held = [], [], 0
    if parts:
        yield np.array(rows, np.int64), parts


_SPACES = " \n\t\r"


def _cut_at(t: str, at: int) -> int:
    while at < len(t):
        nxt = min((p for p in (t.find(c, at) for c in _SPACES) if p >= 0), default=len(t))
        if nxt == len(t):
            return nxt
        if nxt > 0 and not t[nxt - 1].isspace():
            return nxt
        at = nxt + 1
    return len(t)


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, vectorised; the same for every process."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64, copy=True)
        h += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans cp[starts:ends], all at once; spans rise and don't overlap.

    Each code point is mixed with its place in the span, so that no two regular texts collide by construction, as a
    polynomial's would modulo 2**64. The mixed values are summed by prefix sums and mixed again with the length.
    """
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    where = np.arange(at[-1]) - np.repeat(at[:-1], size)
    inside = cp if at[-1] == len(cp) else cp[np.repeat(starts, size) + where]
    with np.errstate(over="ignore"):
        mixed = mix64((inside.astype(np.uint64) << np.uint64(42)) ^ where.astype(np.uint64))
        p = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed, out=p[1:])
        h = p[at[1:]] - p[at[:-1]]
        h += size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h)


_CLASS: np.ndarray | None = None
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """uint8 by code point: other, letter, digit, white space."""
    global _CLASS
    if _CLASS is None:
        import regex

        t = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for code, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                t[m.start() : m.end()] = code
        for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            t[a : b + 1] = SPACE
        _CLASS = t
    return _CLASS


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The joined texts' code points, and where each text starts (one more than texts)."""
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) for t in parts), np.int64, len(parts)), out=at[1:])
    return cp, at


_LOWER: np.ndarray | None = None


def lower_table() -> np.ndarray:
    """uint32 by code point: its lower-case form where that is one code point, else itself."""
    global _LOWER
    if _LOWER is None:
        t = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x1E944):
            low = chr(i).lower()
            if len(low) == 1:
                t[i] = ord(low)
        _LOWER = t
    return _LOWER


def words(parts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters and digits: (code points, starts, ends, text of each, hashes); lower: all in lower case."""
    cp, at = code_points(parts)
    if lower:
        cp = lower_table()[cp]
    c = char_classes()[cp]
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = (c == LETTER) | (c == DIGIT)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(at) > 2 and len(starts):  # a run can't cross into the next text
        inner = at[1:-1]
        k = np.searchsorted(starts, inner, "left") - 1
        ok = (k >= 0) & (inner > starts[k]) & (inner < ends[k])
        if ok.any():
            add = np.unique(inner[ok])
            starts = np.sort(np.concatenate([starts, add]))
            ends = np.sort(np.concatenate([ends, add]))
    text = np.searchsorted(at, starts, "right") - 1
    return cp, starts, ends, text, span_hashes(cp, starts, ends)


def word_batches(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Lower-case words' hashes of whole texts: (rows, hashes in order, where each row's words start, one more at the end).

    Long texts are read in segments, but every row's words come together. Rows without words are left out.
    """
    rows: list[int] = []
    got: list[np.ndarray] = []
    size: list[int] = []
    held = 0
    for seg_rows, parts in segments(texts):
        _, _, _, text, h = words(parts, lower=True)
        n = np.bincount(text, minlength=len(parts))
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        for k, row in enumerate(seg_rows.tolist()):
            if rows and row != rows[-1] and held >= CHUNK_CHARS // 6:
                yield rows, np.concatenate(got), np.concatenate([[0], np.cumsum(size)])
                rows, got, size, held = [], [], [], 0
            if not n[k]:
                continue
            piece = h[at[k] : at[k + 1]]
            held += len(piece)
            got.append(piece)
            if rows and rows[-1] == row:
                size[-1] += len(piece)
            else:
                rows.append(row)
                size.append(len(piece))
    if rows:
        yield rows, np.concatenate(got), np.concatenate([[0], np.cumsum(size)])


def shingle_hashes(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each, hash of each) of all runs of k words; a shorter row gives one of all its words."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    left = at[row + 1] - np.arange(len(h))  # words from here to the row's end
    whole = (left >= k) | ((np.arange(len(h)) == at[row]) & (size[row] < k))
    start = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        out = np.zeros(len(start), np.uint64)
        for j in range(k):
            p = np.minimum(start + j, len(h) - 1)
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(j < left[start], h[p], np.uint64(0))
    return row[start], mix64(out)


def in_parts(texts: pa.Array, limit: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts of an array, about limit bytes at a time: what is made of a batch's texts stays small. What Arrow has set
    free goes back to the system at the end, as idle workers keep it otherwise."""
    for part in sliced(pa.RecordBatch.from_arrays([texts], ["t"]), "t", limit):
        yield part.column(0).to_pylist()
    pa.default_memory_pool().release_unused()


def sliced(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes in a column, so that what is made of them stays small."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield batch.slice(a, b - a)
