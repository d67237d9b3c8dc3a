"""Scoring models as Column arithmetic over a posting's weight and length and its term's and field's statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Stats:
    """Columns: w, length (of the field in the document), df and cf (documents with the term, its weight in all), n (documents), total and avg (lengths of the field); names of field and term."""

    w: Column
    length: Column
    df: Column
    cf: Column
    n: Column
    total: Column
    avg: Column
    field: str
    term: Column
    scorable: bool = True


def idf(s: Stats) -> Column:
    return F.ln(s.n / (s.df + 1)) + 1


class Weighting:
    """A model. final() may adjust a document's score in the end, from its columns."""

    def score(self, s: Stats) -> Column:
        raise NotImplementedError

    def final(self, score: Column) -> Column:
        return score

    def of(self, s: Stats) -> Column:
        """Fields without scores of their own weigh as their postings do."""
        return self.score(s) if s.scorable else s.w


class BM25F(Weighting):
    def __init__(self, B: float = 0.75, K1: float = 1.2, **field_b: float):
        self.b, self.k1 = B, K1
        self.field_b = {k.removesuffix("_B"): v for k, v in field_b.items()}

    def score(self, s: Stats) -> Column:
        b, k = self.field_b.get(s.field, self.b), self.k1
        return idf(s) * (s.w * (k + 1)) / (s.w + k * ((1 - b) + b * s.length / s.avg))


class TF_IDF(Weighting):
    def score(self, s: Stats) -> Column:
        return s.w * idf(s)

    of = score


class Frequency(Weighting):
    def score(self, s: Stats) -> Column:
        return s.w

    of = score


class PL2(Weighting):
    """Poisson with Laplace's after-effect."""

    def __init__(self, c: float = 1.0):
        self.c = c

    def score(self, s: Stats) -> Column:
        tf = s.w * F.ln(1 + self.c * s.avg / s.length)
        f = s.cf / s.n
        log2e = 1 / math.log(2)
        return (tf * F.ln(1 / f) + f * log2e + 0.5 * F.ln(2 * math.pi * tf) + tf * (F.ln(tf) - log2e)) / (tf + 1)


class DFree(Weighting):
    """Divergence from randomness without parameters."""

    def score(self, s: Stats) -> Column:
        prior, post = s.w / s.length, (s.w + 1.0) / (s.length + 1.0)
        spread = s.total / s.cf
        return s.w * F.ln(post / prior) * (s.w * F.ln(prior * spread) + (s.w + 1.0) * F.ln(post * spread) + 0.5 * F.ln(post / prior))


class FunctionWeighting(Weighting):
    """A function of Stats that gives a Column; it may use a pandas UDF."""

    def __init__(self, fn: Callable[[Stats], Column]):
        self.fn = fn

    def score(self, s: Stats) -> Column:
        return self.fn(s)

    of = score


class MultiWeighting(Weighting):
    """A model for each field, and one for the rest."""

    def __init__(self, default: Weighting, **by_field: Weighting):
        self.default, self.by = default, by_field

    def score(self, s: Stats) -> Column:
        return self.by.get(s.field, self.default).score(s)

    def of(self, s: Stats) -> Column:
        return self.by.get(s.field, self.default).of(s)


class DebugModel(Weighting):
    """Another model, or the term's weight, with each posting's statistics beside the score: explain() for reading, score()
    as that model scores."""

    def __init__(self, weighting: Weighting | None = None):
        self.inner = weighting or Frequency()

    def score(self, s: Stats) -> Column:
        return self.inner.score(s)

    def of(self, s: Stats) -> Column:
        return self.inner.of(s)

    def explain(self, s: Stats) -> Column:
        return F.struct(s.w.alias("weight"), s.length.alias("length"), s.df.alias("df"), s.cf.alias("cf"), s.n.alias("n"), s.avg.alias("avg"), self.of(s).alias("score"))


class ReverseWeighting(Weighting):
    def __init__(self, weighting: Weighting):
        self.inner = weighting

    def score(self, s: Stats) -> Column:
        return -self.inner.score(s)

    def of(self, s: Stats) -> Column:
        return -self.inner.of(s)
