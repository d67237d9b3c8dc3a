"""Places in documents as array<struct<s int, e int>> columns (first and last position), and their algebra."""

from __future__ import annotations

import bisect

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.analysis import let

NONE = "array<struct<s:int,e:int>>"


def before_place(spans: list[tuple[int, int]], place: int) -> int:
    """How many spans of a list sorted by start begin before a place."""
    return bisect.bisect_left([s for s, _ in spans], place)


def none() -> Column:
    return F.array().cast(NONE)


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def of_positions(p: Column) -> Column:
    return F.transform(F.coalesce(p, F.array().cast("array<int>")), lambda x: span(x, x))


def near(a: Column, b: Column, slop: int, ordered: bool, mindist: int) -> Column:
    """Every pair that lies mindist to slop apart, as one span from the first position to the last; each once, in order."""

    def pairs(x: Column) -> Column:
        def fits(y: Column) -> Column:
            ahead = y["s"] - x["e"]
            ok = (ahead >= mindist) & (ahead <= slop)
            if not ordered:
                back = x["s"] - y["e"]
                ok |= (back >= mindist) & (back <= slop)
            return ok

        return F.transform(F.filter(b, fits), lambda y: span(F.least(x["s"], y["s"]), F.greatest(x["e"], y["e"])))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(a, pairs))))


def bound(fn, a: Column, b: Column, *more) -> Column:
    """fn(a, b) with both worked out once."""
    return let(a, lambda x: let(b, lambda y: fn(x, y, *more)))


def first(a: Column, limit: int) -> Column:
    return F.filter(a, lambda x: x["e"] <= limit)


def outside(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.exists(b, lambda y: (x["s"] <= y["e"]) & (y["s"] <= x["e"])))


def containing(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: F.exists(b, lambda y: (x["s"] <= y["s"]) & (y["e"] <= x["e"])))


def before(a: Column, b: Column) -> Column:
    start = F.array_min(F.transform(b, lambda y: y["s"]))
    return F.filter(a, lambda x: x["e"] < start)


def merged(a: Column) -> Column:
    """Overlapping and touching places drawn together."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (x["s"] <= last["e"] + 1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(span(last["s"], F.greatest(last["e"], x["e"]))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(a), none(), step)
