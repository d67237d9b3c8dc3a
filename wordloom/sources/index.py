"""An index on disk: segments of Parquet tables under a folder, published by generations of a JSON manifest.

A segment holds docs (doc_id, columns, a length for each scored field), and postings by field in blocks of a term (see
sources.postings), range-partitioned and sorted by term, so that a query's terms are found by row-group statistics; beside them
lies a sketch of their terms (terms_*.json), by which a fold deals its partitions. Its texts are cut into words once for lengths
and once for postings. Deletions are written beside the segments and taken out when they are read; optimize() folds everything
into one segment by merging blocks. Nothing that is published is written again; vacuum() removes what no manifest names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import words
from wordloom.functions.formats import FieldType, Schema, merge_schemas
from wordloom.operators import query as Q
from wordloom.sources.corpus import Corpus, FrameCorpus, Predicate, spread, summed
from wordloom.sources.postings import LISTS, blocks, bounds, closed, dealt, joined, merged, opened, sample_of, sketch, sketch_of, without

LENGTH = "_length_"
#: Deletions of up to so many documents are sent to the tables that they are taken out of; more meet them by shuffle.
SENT_DELETIONS = 1_000_000
#: Tables from so many bytes on are dealt to all cores (see spread) before they are analysed.
DEALT_BYTES = 4 << 20


class EmptyIndexError(Exception):
    """The folder holds no index."""


class OutOfDateError(Exception):
    """Another writer published since this one began."""


@dataclass
class Manifest:
    generation: int = 0
    segments: list[str] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    #: 1: postings of a row each; 2: blocks of them; 3: blocks of fewer columns. All are read.
    version: int = 3


class _Files:
    """Any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self) -> list[str]:
        if not self.fs.exists(self._path(self.root)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Written under another name and then renamed; fails if the name is taken."""
        temp, final = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self.fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(temp, final):
            self.fs.delete(temp, False)
            raise OutOfDateError(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


def _generations(files: _Files) -> list[int]:
    return sorted(int(n[9:-5]) for n in files.names() if n.startswith("manifest-") and n.endswith(".json"))


def exists_in(spark: SparkSession, path: str) -> bool:
    return bool(_generations(_Files(spark, path)))


def create_in(spark: SparkSession, path: str, schema: Schema) -> Index:
    """An index without documents; what was published there before is no longer seen."""
    files = _Files(spark, path)
    last = _generations(files)
    files.fs.mkdirs(files._path(path))
    files.create(f"manifest-{(last[-1] if last else 0) + 1:08d}.json", json.dumps(Manifest((last[-1] if last else 0) + 1, fields=schema.names()).__dict__))
    return Index(spark, path, schema)


def exists(spark: SparkSession, path: str, generation: int | None = None) -> bool:
    """Whether a folder holds an index, or a generation of it that wasn't removed."""
    found = _generations(_Files(spark, path))
    return bool(found) if generation is None else generation in found


def version_in(spark: SparkSession, path: str) -> tuple[int, int]:
    """(format, generation) of the index in a folder, without opening its tables."""
    files = _Files(spark, path)
    last = _generations(files)
    if not last:
        raise EmptyIndexError(path)
    return json.loads(files.read(f"manifest-{last[-1]:08d}.json"))["version"], last[-1]


def copy_to(spark: SparkSession, path: str, to: str) -> None:
    """All that the latest generation names, copied to another folder or file system."""
    src, dst = _Files(spark, path), _Files(spark, to)
    last = _generations(src)
    if not last:
        raise EmptyIndexError(path)
    name = f"manifest-{last[-1]:08d}.json"
    dst.fs.mkdirs(dst._path(to))
    m = json.loads(src.read(name))
    for part in (*m["segments"], *m["deletions"]):
        src.jvm.org.apache.hadoop.fs.FileUtil.copy(src.fs, src._path(f"{src.root}/{part}"), dst.fs, dst._path(f"{dst.root}/{part}"), False, spark._jsc.hadoopConfiguration())
    dst.create(name, src.read(name))  # last, so that no reader sees a part of it


def open_dir(spark: SparkSession, path: str, schema: Schema) -> Index:
    if not exists_in(spark, path):
        raise EmptyIndexError(path)
    return Index(spark, path, schema)


class Index(Corpus):
    def __init__(self, spark: SparkSession, path: str, schema: Schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.files = _Files(spark, path)
        self._sizes: dict[tuple[str, ...], int] = {}
        self.manifest = self._latest()

    def _latest(self) -> Manifest:
        last = _generations(self.files)
        if not last:
            raise EmptyIndexError(self.path)
        return Manifest(**json.loads(self.files.read(f"manifest-{last[-1]:08d}.json")))

    def refresh(self) -> Index:
        return Index(self.spark, self.path, self.schema)

    def up_to_date(self) -> bool:
        return _generations(self.files)[-1] == self.manifest.generation

    def version(self) -> tuple[int, int]:
        return self.manifest.version, self.manifest.generation

    def is_empty(self) -> bool:
        return not self.manifest.segments

    def _deleted(self, segment: str) -> DataFrame | None:
        """doc_ids deleted after the segment was written."""
        own = [p for p in self.manifest.deletions if p.split("@")[0] >= segment.split("@")[0]]
        if not own:
            return None
        gone = self.spark.read.parquet(*(f"{self.path}/{p}" for p in own)).select("doc_id")
        key = tuple(own)
        if key not in self._sizes:
            self._sizes[key] = gone.count()  # by the files' footers
        return F.broadcast(gone) if self._sizes[key] <= SENT_DELETIONS else gone

    def _gone(self, segment: str) -> np.ndarray | None:
        """doc_ids deleted after the segment was written, in order; None if they are too many to be sent."""
        gone = self._deleted(segment)
        if gone is None:
            return np.zeros(0, "int64")
        ids = gone.limit(SENT_DELETIONS + 1).toArrow().column("doc_id").to_numpy()
        return None if len(ids) > SENT_DELETIONS else np.unique(ids)

    def _live_of(self, segment: str, what: str, use: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
        df = use(self.spark.read.parquet(f"{self.path}/{segment}/{what}"))
        gone = self._deleted(segment)
        return df if gone is None else df.join(gone, "doc_id", "left_anti")

    def _live(self, what: str, use: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame | None:
        parts = [self._live_of(s, what, use) for s in self.manifest.segments if not what.startswith("postings") or what in self._tables(s)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _tables(self, segment: str) -> set[str]:
        p = self.files._path(f"{self.path}/{segment}")
        return {f.getPath().getName() for f in self.files.fs.listStatus(p)}

    def docs(self) -> DataFrame:
        out = self._live("docs")
        if out is None:
            cols = ", ".join(f"{n} string" for n in self.schema.names())
            return self.spark.createDataFrame([], f"doc_id bigint{', ' + cols if cols else ''}")
        return out.drop(*(c for c in out.columns if c.startswith(LENGTH)))

    def postings(self, name: str, where: Predicate | None = None, positions: bool = False) -> DataFrame:
        def use(df: DataFrame) -> DataFrame:
            df = df if where is None else df.where(where(F.col("term")))
            df = opened(df, positions and "positions" in df.columns) if "doc_ids" in df.columns else df
            return df if positions or "positions" not in df.columns else df.drop("positions")

        out = self._live(f"postings_{name}", use)
        if out is None:
            out = self.spark.createDataFrame([], "term string, doc_id bigint, tf int, weight double, length int" + (", positions array<int>" if positions else ""))
        return out.withColumn("field", F.lit(name))

    def field_stats(self, fields: list[str]) -> DataFrame:
        live = self._live("docs", lambda d: d.select("doc_id", *(c for f in fields if (c := LENGTH + f) in d.columns)))
        if live is None:
            return self.spark.createDataFrame([(0, *([0] * len(fields)), *([1.0] * len(fields)))], "n bigint" + "".join(f", total_{f} bigint" for f in fields) + "".join(f", avg_{f} double" for f in fields))
        return summed(live, {f: LENGTH + f for f in fields})

    def lengths(self, field: str) -> DataFrame:
        live = self._live("docs", lambda d: d.select("doc_id", F.col(LENGTH + field).alias("length")))
        return live if live is not None else self.spark.createDataFrame([], "doc_id bigint, length int")

    def doc_count_all(self) -> int:
        return sum(self.spark.read.parquet(f"{self.path}/{s}/docs").count() for s in self.manifest.segments)  # by the files' footers

    def is_deleted(self, doc_id: int) -> bool:
        """Whether a document was written and has been deleted since."""
        own = F.col("doc_id") == doc_id
        written = any(not self.spark.read.parquet(f"{self.path}/{s}/docs").where(own).isEmpty() for s in self.manifest.segments)
        return written and self.docs().where(own).isEmpty()

    # changes

    def writer(self) -> Writer:
        return Writer(self)

    def delete_by_term(self, name: str, text: str) -> None:
        self.delete_by_query(Q.Term(name, text))

    def delete_by_query(self, q: Q.Query) -> None:
        w = self.writer()
        w.delete_by_query(q)
        w.commit()

    def delete_document(self, doc_id: int) -> None:
        w = self.writer()
        w.delete_documents(self.spark.createDataFrame([(doc_id,)], "doc_id bigint"))
        w.commit()

    def to_frame(self) -> FrameCorpus:
        """The live documents as a corpus of their own, apart from the index's postings; the caller may cache its frame."""
        return FrameCorpus(self.docs(), self.schema)

    def optimize(self) -> None:
        """One segment of all live documents."""
        w = self.writer()
        w.commit(optimize=True)

    def optimize_to(self, path: str) -> Index:
        """One segment of all live documents in an index of another folder; this one stays as it is."""
        out = create_in(self.spark, path, self.schema)
        if self.manifest.segments:
            w, name = self.writer(), f"{out.manifest.generation + 1:08d}-c@{uuid.uuid4().hex[:8]}"
            w.to = out.path
            w._fold(name)
            out._publish([name], [])
        return out

    def vacuum(self) -> list[str]:
        """Remove what the latest manifest doesn't name; older handles stop working."""
        keep = {*self._latest().segments, *self._latest().deletions, f"manifest-{self._latest().generation:08d}.json"}
        gone = [n for n in self.files.names() if n not in keep and not n.startswith(".")]
        for n in gone:
            self.files.delete(n)
        return gone

    def add_field(self, name: str, kind: FieldType) -> None:
        self.schema.add(name, kind)
        self._publish(self.manifest.segments, self.manifest.deletions)

    def remove_field(self, name: str) -> None:
        """The column stays in the segments until they are optimized."""
        self.schema.remove(name)
        self._publish(self.manifest.segments, self.manifest.deletions)

    def _publish(self, segments: list[str], deletions: list[str]) -> None:
        g = self.manifest.generation + 1
        self.files.create(f"manifest-{g:08d}.json", json.dumps(Manifest(g, segments, deletions, self.schema.names()).__dict__))
        self.manifest = self._latest()


class Writer:
    """Collects changes; commit() publishes them together, cancel() forgets them.

    Of two writers that began at one generation the second to commit gets OutOfDateError.
    """

    def __init__(self, index: Index):
        self.index = index
        self.to = index.path
        self.added: list[DataFrame] = []
        self.gone: list[DataFrame] = []
        self.columns: dict[str, Column] = {}

    def add_documents(self, df: DataFrame) -> None:
        """Rows with doc_id and the schema's columns."""
        self.added.append(df)

    def update_documents(self, df: DataFrame) -> None:
        """Committed documents that share a unique field's value (or a doc_id) with a row are replaced; of rows that share one the last by doc_id stays."""
        unique = [n for n in self.index.schema.names() if self.index.schema[n].unique and n in df.columns] or ["doc_id"]
        for name in unique:
            if not self.index.is_empty():
                old = self.index.docs()
                self.gone.append(old.join(df.select(name).distinct(), name, "left_semi").select("doc_id"))
        last = F.max("doc_id").alias("doc_id")
        self.added.append(df.join(df.groupBy(unique[0]).agg(last).select("doc_id"), "doc_id", "left_semi") if unique != ["doc_id"] else df.dropDuplicates(["doc_id"]))

    def delete_by_query(self, q: Q.Query) -> None:
        self.gone.append(self.index.searcher().docs_for_query(q, for_deletion=True))

    def delete_by_term(self, name: str, text: str) -> None:
        self.delete_by_query(Q.Term(name, text))

    def delete_documents(self, ids: DataFrame) -> None:
        self.gone.append(ids.select("doc_id"))

    def cancel(self) -> None:
        self.added, self.gone, self.columns = [], [], {}

    def add_reader(self, corpus: Corpus) -> None:
        """All live documents of another corpus."""
        self.added.append(corpus.docs())

    def add_column(self, name: str, value: Column) -> None:
        """A column for every document, worked out from its others when the changes are committed, which folds the segments."""
        self.columns[name] = value

    def commit(self, optimize: bool = False, clear: bool = False, merge_below: int = 0, fan: int = 4) -> None:
        """optimize: fold all segments into one. clear: only what was added stays. merge_below: fold segments of fewer
        documents than that into one where there are at least fan of them."""
        ix = self.index
        if not ix.up_to_date():
            raise OutOfDateError(f"generation {ix.manifest.generation}")
        segments = [] if clear else list(ix.manifest.segments)
        deletions = [] if clear else list(ix.manifest.deletions)
        n = ix.manifest.generation + 1
        # names rise with the generation, deletions before the segment of their own commit
        if self.gone and not clear:
            name = f"{n:08d}-a@{uuid.uuid4().hex[:8]}"
            reduce(DataFrame.unionByName, self.gone).distinct().write.parquet(f"{ix.path}/{name}")
            deletions.append(name)
        if self.added:
            name = f"{n:08d}-b@{uuid.uuid4().hex[:8]}"
            self._segment(name, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.added))
            segments.append(name)
        small = [s for s in segments if ix.spark.read.parquet(f"{ix.path}/{s}/docs").count() < merge_below] if merge_below and not optimize else []
        if self.columns or optimize and (segments or deletions):
            small = segments
        if small and (small is segments or len(small) >= fan):
            # the fold's name is later than all deletions so far, which have been taken out of it
            ix.manifest = Manifest(ix.manifest.generation, small, deletions, ix.schema.names())
            name = f"{n:08d}-c@{uuid.uuid4().hex[:8]}"
            self._fold(name)
            segments = [*(s for s in segments if s not in small), name]
            deletions = [] if small is segments or len(segments) == 1 else deletions
        ix._publish(segments, deletions)
        self.cancel()

    def _segment(self, name: str, df: DataFrame) -> None:
        ix = self.index
        indexed = self._indexed(df)
        spread(df, DEALT_BYTES).select("*", *(self._size(f).alias(LENGTH + f) for f in indexed)).write.parquet(f"{ix.path}/{name}/docs")
        docs = ix.spark.read.schema(df.schema).parquet(f"{ix.path}/{name}/docs")
        for f in indexed:
            between = bounds(terms := sketch_of(docs, f, ix.schema[f]))
            self._postings(name, f, dealt(blocks(docs, f, ix.schema[f], between), between).sortWithinPartitions("term"), terms)

    def _size(self, f: str) -> Column:
        analyzer = self.index.schema[f].analyzer
        plain = analyzer.plain()
        return analyzer.size(F.col(f)) if plain is None else words.size(F.col(f), words.letters(self.index.spark), *plain)

    def _indexed(self, df: DataFrame) -> list[str]:
        schema = self.index.schema
        return [f for f in schema.names(df.columns) if f in df.columns and schema[f].indexed]

    def _postings(self, name: str, f: str, ordered: DataFrame, terms: list[tuple[str, int]]) -> None:
        """Terms are looked for in row groups; lists are never, nor are two of them alike. terms: what a fold deals by."""
        w = ordered.write.option("parquet.block.size", 16 << 20)
        for c in LISTS:
            w = w.option(f"parquet.enable.dictionary#{c}", "false").option(f"parquet.column.statistics.enabled#{c}", "false")
        w.parquet(f"{self.to}/{name}/postings_{f}")
        _Files(self.index.spark, self.to).create(f"{name}/terms_{f}.json", json.dumps(terms))

    def _fold(self, name: str) -> None:
        """The manifest's segments as one, of live documents: lengths and postings are taken over, and made only where a
        segment lacks them (of fields that the schema got later, of columns that are added now)."""
        ix = self.index
        columns = [c for c in ix.docs().columns if not c.startswith(LENGTH)]
        indexed = self._indexed(ix.docs().withColumns(self.columns))
        kept: dict[str, list[str]] = {f: [] for f in indexed}
        made: dict[str, list[DataFrame]] = {f: [] for f in indexed}
        docs = []
        for s in ix.manifest.segments:
            own, tables = ix._live_of(s, "docs"), ix._tables(s)
            lacking = []
            for f in indexed:
                there = ix.spark.read.parquet(f"{ix.path}/{s}/postings_{f}").columns if f"postings_{f}" in tables and f not in self.columns else []
                if LENGTH + f in own.columns and there and ("positions" in there or not ix.schema[f].positions):
                    kept[f].append(s)
                else:
                    lacking.append(f)
            rows = own.withColumns({c: F.lit(None).cast(ix.docs().schema[c].dataType) for c in columns if c not in own.columns}).withColumns(self.columns)
            for f in lacking:
                made[f].append(rows)
            docs.append(rows.withColumns({LENGTH + f: self._size(f) for f in lacking}))
        names = [*columns, *(c for c in self.columns if c not in columns), *(LENGTH + f for f in indexed)]
        reduce(DataFrame.unionByName, (d.select(*names) for d in docs)).write.parquet(f"{self.to}/{name}/docs")
        n = ix.spark.read.parquet(f"{self.to}/{name}/docs").count()
        for f in indexed:
            sizes = [self._count(s) for s in kept[f]], [d.count() for d in made[f]]
            terms = merged([*(self._terms(s, f, k) for s, k in zip(kept[f], sizes[0])), *(sketch_of(d, f, ix.schema[f]) for d in made[f])], n / max(1, sum(map(sum, sizes))))
            between = bounds(terms)
            parts = [*(self._live_blocks(s, f, between) for s in kept[f]), *(blocks(d, f, ix.schema[f], between) for d in made[f])]
            self._postings(name, f, joined(dealt(reduce(DataFrame.unionByName, parts), between).sortWithinPartitions("term")), terms)

    def _read(self, segment: str, f: str) -> DataFrame:
        """Blocks of a segment."""
        df = self.index.spark.read.parquet(f"{self.index.path}/{segment}/postings_{f}")
        df = df if "doc_ids" in df.columns else closed(df, "positions" in df.columns)
        return df if self.index.schema[f].positions else df.drop("positions")

    def _count(self, segment: str) -> int:
        return self.index.spark.read.parquet(f"{self.index.path}/{segment}/docs").count()  # by the files' footers

    def _terms(self, segment: str, f: str, n: int) -> list[tuple[str, int]]:
        """A segment's sketch, as it was written; of one that has none, by a sample of its n documents."""
        if (name := f"terms_{f}.json") in self.index._tables(segment):
            return [(t, c) for t, c in json.loads(self.index.files.read(f"{segment}/{name}"))]
        return sketch(sample_of(self._read(segment, f), n), n)

    def _live_blocks(self, segment: str, f: str, between: list[str]) -> DataFrame:
        """Blocks of a segment without what was deleted since, and the partition of each."""
        df, gone = self._read(segment, f), self.index._gone(segment)
        if gone is None:
            positions = "positions" in df.columns
            df = closed(opened(df, positions).join(self.index._deleted(segment), "doc_id", "left_anti"), positions)
        return without(df, np.zeros(0, "int64") if gone is None else gone, between)


class QueuedWriter:
    """Changes that wait until the index can be written: commit() takes them to the latest generation, again and again while
    other writers come first."""

    def __init__(self, index: Index, tries: int = 20, wait: float = 0.25):
        self.index, self.tries, self.wait = index, tries, wait
        self.queue: list[tuple[str, tuple]] = []

    def __getattr__(self, name: str) -> Callable[..., None]:
        if name not in ("add_documents", "update_documents", "delete_by_query", "delete_by_term", "delete_documents", "add_reader", "add_column"):
            raise AttributeError(name)
        return lambda *args: self.queue.append((name, args))

    def cancel(self) -> None:
        self.queue = []

    def commit(self, **how: bool | int) -> None:
        for left in reversed(range(self.tries)):
            self.index = self.index.refresh()
            w = self.index.writer()
            for name, args in self.queue:
                getattr(w, name)(*args)
            try:
                w.commit(**how)
            except OutOfDateError:
                if not left:
                    raise
                time.sleep(self.wait)
            else:
                self.queue = []
                return


class BufferedWriter(QueuedWriter):
    """A queue that commits itself once it holds limit frames or is period seconds old, and before it is searched."""

    def __init__(self, index: Index, limit: int = 100, period: float | None = 60.0, **how: int | float):
        super().__init__(index, **how)
        self.limit, self.period, self.began = limit, period, time.monotonic()

    def __getattr__(self, name: str) -> Callable[..., None]:
        push = super().__getattr__(name)

        def pushed(*args: object) -> None:
            push(*args)
            if len(self.queue) >= self.limit or self.period is not None and time.monotonic() - self.began >= self.period:
                self.commit()

        return pushed

    def commit(self, **how: bool | int) -> None:
        if self.queue:
            super().commit(**how)
        self.began = time.monotonic()

    def searcher(self, weighting=None):
        self.commit()
        return self.index.searcher(weighting)

    def close(self) -> None:
        self.commit()

    def __enter__(self) -> BufferedWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def add_sortable(index: Index, name: str, value: Column) -> None:
    """Give every document of an index a column to sort and group by."""
    w = index.writer()
    w.add_column(name, value)
    w.commit()


def add_spelling(index: Index, names: list[str]) -> None:
    """Let fields of an index serve for suggestions."""
    for n in names:
        index.schema[n].spelling = True
    index._publish(index.manifest.segments, index.manifest.deletions)


class Together(Corpus):
    """Several corpora as one; with overlay, a document of a later one hides those of the same doc_id before it."""

    def __init__(self, corpora: list[Corpus], overlay: bool = False):
        self.corpora, self.overlay = corpora, overlay
        self.schema, self.spark = merge_schemas([c.schema for c in corpora]), corpora[0].spark

    def _all(self, read: Callable[[Corpus], DataFrame | None]) -> DataFrame:
        parts = []
        for k, c in enumerate(self.corpora):
            df = read(c)
            if df is None:
                continue
            for later in self.corpora[k + 1 :] if self.overlay else ():
                df = df.join(later.docs().select("doc_id"), "doc_id", "left_anti")
            parts.append(df)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def docs(self) -> DataFrame:
        return self._all(lambda c: c.docs())

    def postings(self, field: str, where: Predicate | None = None, positions: bool = False) -> DataFrame:
        return self._all(lambda c: c.postings(field, where, positions) if field in c.schema else None)

    def lengths(self, field: str) -> DataFrame:
        return self._all(lambda c: c.lengths(field) if field in c.schema else c.docs().select("doc_id", F.lit(0).alias("length")))

    def field_stats(self, fields: list[str]) -> DataFrame:
        own = self.docs().select("doc_id")
        for f in fields:
            own = own.join(self.lengths(f).withColumnRenamed("length", LENGTH + f), "doc_id", "left")
        return summed(own, {f: LENGTH + f for f in fields})
