"""Spelling: terms near a word, and queries and their texts corrected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import query as Q
from wordloom.sources.corpus import Corpus


def terms_within(corpus: Corpus, field: str, text: str, maxdist: int, prefix: int = 0) -> DataFrame:
    """(term, distance, cf) of terms within an edit distance that share the first prefix characters."""
    d = lambda t: F.levenshtein(t, F.lit(text), maxdist)
    near = lambda t: t.startswith(text[:prefix]) & (F.abs(F.length(t) - len(text)) <= maxdist) & (d(t) >= 0)
    return corpus.terms_with(field, near).select("term", d(F.col("term")).alias("distance"), "cf")


def suggestions(corpus: Corpus, field: str, text: str, limit: int = 5, maxdist: int = 2, prefix: int = 0) -> DataFrame:
    """The nearest terms, more frequent ones first among equals."""
    return terms_within(corpus, field, text, maxdist, prefix).orderBy("distance", F.desc("cf"), "term").limit(limit)


def list_suggestions(words: DataFrame, text: str, limit: int = 5, maxdist: int = 2, prefix: int = 0) -> DataFrame:
    """The same from a list of words (column term)."""
    d = F.levenshtein("term", F.lit(text), maxdist)
    return words.where(F.col("term").startswith(text[:prefix]) & (d >= 0)).select("term", d.alias("distance")).distinct().orderBy("distance", "term").limit(limit)


def multi_suggestions(sources: list[tuple[DataFrame, float]], limit: int = 5) -> DataFrame:
    """The best of several suggestion frames (term, distance, ...), each with a weight by which its distances are multiplied."""
    parts = [df.select("term", (F.col("distance") * w).alias("distance")) for df, w in sources]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("term").agg(F.min("distance").alias("distance")).orderBy("distance", "term").limit(limit)


@dataclass
class Correction:
    query: Q.Query
    text: str
    corrected_query: Q.Query
    corrected_text: str
    changes: dict[str, str]

    def format_string(self, before: str = "<strong>", after: str = "</strong>") -> str:
        out = self.text
        for old, new in self.changes.items():
            out = _swap(out, old, f"{before}{new}{after}")
        return out


def _swap(text: str, old: str, new: str) -> str:
    import re

    return re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", lambda m: new, text, flags=re.I)


def correct_query(corpus: Corpus, q: Q.Query, text: str, maxdist: int = 2, prefix: int = 0) -> Correction:
    """Terms that no document has are replaced by the best suggestion; one lookup of all terms."""
    terms = sorted(q.all_terms())
    changes: dict[str, str] = {}
    fixed = q
    for field in sorted({f for f, _ in terms}):
        own = [t for f, t in terms if f == field]
        have = {r["term"] for r in corpus.terms_with(field, lambda t, own=own: t.isin(own)).select("term").collect()}  # the query's terms at most
        for word in own:
            if word not in have:
                best = suggestions(corpus, field, word, 1, maxdist, prefix).first()
                if best:
                    changes[word] = best["term"]
                    fixed = fixed.replace_text(field, word, best["term"])
    new = text
    for old, better in changes.items():
        new = _swap(new, old, better)
    return Correction(q, text, fixed, new, changes)
