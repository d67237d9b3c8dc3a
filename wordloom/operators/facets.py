"""Sort keys and groupings over the columns of matched documents, and what is kept for each group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators import query as Q


class Facet:
    """key(): a column; an array of keys where a document may be in several groups (overlap)."""

    overlap = False
    reverse = False

    def key(self) -> Column:
        raise NotImplementedError

    def prepare(self, rows: DataFrame, corpus) -> DataFrame:
        """rows with whatever key() reads."""
        return rows

    def order(self, reverse: bool = False) -> list[Column]:
        """Missing values come last, or first when reversed."""
        k = self.key()
        return [k.desc_nulls_first() if self.reverse != reverse else k.asc_nulls_last()]


@dataclass
class FieldFacet(Facet):
    name: str
    reverse: bool = False
    overlap: bool = False
    split: str | None = None

    def key(self) -> Column:
        if self.overlap:
            return F.split(F.col(self.name), self.split) if self.split else F.filter(F.split(F.col(self.name), r"[\s,]+"), lambda x: x != "")
        return F.col(self.name)


@dataclass
class StoredFieldFacet(FieldFacet):
    """By a stored column; a function Column -> Column of arrays may split it."""

    split_fn: Callable[[Column], Column] | None = None

    def key(self) -> Column:
        return self.split_fn(F.col(self.name)) if self.split_fn else super().key()


@dataclass
class RangeFacet(Facet):
    """Buckets [start, end) of gap, or of a list of gaps whose last one goes on; with hardend the last bucket stops at end."""

    name: str
    start: float
    end: float
    gap: float | list[float]
    hardend: bool = False

    def bounds(self) -> list[tuple[float, float]]:
        gaps = list(self.gap) if isinstance(self.gap, (list, tuple)) else [self.gap]
        out, at, k = [], self.start, 0
        while at < self.end:
            to = at + gaps[min(k, len(gaps) - 1)]
            if self.hardend:
                to = min(to, self.end)
            out.append((at, to))
            at, k = to, k + 1
        return out

    def key(self) -> Column:
        c, bounds = F.col(self.name), self.bounds()
        if not isinstance(self.gap, (list, tuple)) and not self.hardend:
            low = F.floor((c - self.start) / self.gap) * self.gap + self.start
            return F.when((c >= self.start) & (c < bounds[-1][1]), F.struct(low.cast("double").alias("low"), (low + self.gap).cast("double").alias("high")))
        out = F.lit(None)
        for a, b in reversed(bounds):
            out = F.when((c >= a) & (c < b), F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"))).otherwise(out)
        return out


@dataclass
class DateRangeFacet(Facet):
    """Buckets of time from start to end; gap is a timedelta or an interval such as "1 month"."""

    name: str
    start: Any
    end: Any
    gap: Any
    hardend: bool = False

    def key(self) -> Column:
        c = F.col(self.name).cast("timestamp_ntz")
        start, end = F.lit(self.start).cast("timestamp_ntz"), F.lit(self.end).cast("timestamp_ntz")
        words = str(self.gap).split() if isinstance(self.gap, str) else []
        if words and words[1].rstrip("s") in ("month", "year"):
            n = int(words[0]) * (12 if words[1].startswith("year") else 1)
            # months since start; an offset of days within the month counts
            k = F.floor(F.months_between(c, start) / n).cast("int")
            low = start + F.make_ym_interval(F.lit(0), (k * n).cast("int"))
            high = start + F.make_ym_interval(F.lit(0), ((k + 1) * n).cast("int"))
        else:
            seconds = self.gap.total_seconds() if not words else int(words[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[words[1].rstrip("s")]
            k = F.floor((F.unix_micros(c.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(int(seconds * 1_000_000)))
            low = start + F.make_dt_interval(secs=(k * seconds).cast("decimal(18,6)"))
            high = start + F.make_dt_interval(secs=((k + 1) * seconds).cast("decimal(18,6)"))
        if self.hardend:
            high = F.least(high, end)
        return F.when((c >= start) & (c < end), F.struct(low.alias("low"), high.alias("high")))


@dataclass
class QueryFacet(Facet):
    """The name of the first query that matches, in the order given; with overlap of all of them."""

    queries: dict[str, Q.Query]
    other: str | None = None
    overlap: bool = False

    def prepare(self, rows: DataFrame, corpus) -> DataFrame:
        from wordloom.operators.compile import compiled

        for k, q in enumerate(self.queries.values()):
            rows = rows.join(compiled(q, corpus, scored=False).select("doc_id", F.lit(True).alias(f"_q{k}")), "doc_id", "left")
        return rows

    def key(self) -> Column:
        names = list(self.queries)
        hits = [F.when(F.col(f"_q{k}"), F.lit(n)) for k, n in enumerate(names)]
        if self.overlap:
            return F.array_compact(F.array(*hits))
        return F.coalesce(*hits, F.lit(self.other))


class ScoreFacet(Facet):
    def key(self) -> Column:
        return -F.col("score")


@dataclass
class FunctionFacet(Facet):
    """A function of the document's row: Column expressions, or a UDF over its columns."""

    fn: Callable[[], Column]

    def key(self) -> Column:
        return self.fn()


@dataclass
class TranslateFacet(Facet):
    fn: Callable[..., Column]
    facets: list[Facet] = field(default_factory=list)

    def prepare(self, rows: DataFrame, corpus) -> DataFrame:
        for f in self.facets:
            rows = f.prepare(rows, corpus)
        return rows

    def key(self) -> Column:
        return self.fn(*(f.key() for f in self.facets))


@dataclass
class MultiFacet(Facet):
    facets: list[Facet]

    def prepare(self, rows: DataFrame, corpus) -> DataFrame:
        for f in self.facets:
            rows = f.prepare(rows, corpus)
        return rows

    def key(self) -> Column:
        return F.struct(*(f.key().alias(f"k{i}") for i, f in enumerate(self.facets)))

    def order(self, reverse: bool = False) -> list[Column]:
        return [c for f in self.facets for c in f.order(reverse)]


def facet(x: str | Facet | list) -> Facet:
    """A facet from a column's name, a list of them, or a facet."""
    if isinstance(x, Facet):
        return x
    return FieldFacet(x) if isinstance(x, str) else MultiFacet([facet(y) for y in x])


def facets(x: Any) -> dict[str, Facet]:
    """Groupings by name from a name, a facet, a list or a dict of them."""
    if isinstance(x, dict):
        return {k: facet(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return {getattr(y, "name", y if isinstance(y, str) else f"facet{i}"): facet(y) for i, y in enumerate(x)}
    return {x if isinstance(x, str) else getattr(x, "name", "facet"): facet(x)}


# What is kept of a group


def Count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def OrderedList(rows: DataFrame) -> DataFrame:
    """The group's documents, best first, ties by doc_id."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id")))
    return rows.groupBy("key").agg(F.transform(order, lambda x: x["doc_id"]).alias("docs"))


def UnorderedList(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.collect_list("doc_id").alias("docs"))


def Best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id"))["doc_id"].alias("doc_id"))


def grouped(rows: DataFrame, by: Facet, corpus, kept: Callable[[DataFrame], DataFrame] = Count) -> DataFrame:
    """rows (doc_id, score, columns) by a facet's key; documents without a key are in the group null."""
    rows = by.prepare(rows, corpus)
    k = by.key()
    if by.overlap:
        rows = rows.withColumn("key", F.explode_outer(k))
    else:
        rows = rows.withColumn("key", k)
    return kept(rows)
