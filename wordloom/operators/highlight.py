"""Excerpts of texts around what matched, as a column."""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.analysis import WORD, Analyzer, LowercaseFilter, MapFilter
from wordloom.operators import query as Q


@dataclass
class Fragment:
    start: int
    end: int
    matches: list[tuple[int, int, str]]


@dataclass
class WholeFragmenter:
    charlimit: int | None = None

    def fragments(self, text: str, matches: list[tuple[int, int, str]]) -> list[Fragment]:
        return [Fragment(0, len(text), matches)]


@dataclass
class SentenceFragmenter:
    maxchars: int = 200
    ends: str = ".!?"

    def fragments(self, text: str, matches: list[tuple[int, int, str]]) -> list[Fragment]:
        out, at = [], 0
        for m in re.finditer(rf"[{re.escape(self.ends)}]+\s*|\Z", text):
            own = [x for x in matches if at <= x[0] < m.end()]
            if own and m.end() - at > 0:
                end = m.end()
                if end - at > self.maxchars:  # as much of it as fits, from the first match on
                    first = own[0][0]
                    start = at if own[-1][1] - at <= self.maxchars else first
                    end = min(end, start + self.maxchars)
                    own = [x for x in own if x[1] <= end and x[0] >= start]
                    out.append(Fragment(start, end, own))
                else:
                    out.append(Fragment(at, len(text[:end].rstrip()), own))
            at = m.end()
        return out


@dataclass
class ContextFragmenter:
    """Matches with so many characters around them, grown to whole words; neighbours share a fragment while it stays short."""

    maxchars: int = 200
    surround: int = 20

    def fragments(self, text: str, matches: list[tuple[int, int, str]]) -> list[Fragment]:
        out: list[Fragment] = []
        for a, b, t in matches:
            lo, hi = max(0, a - self.surround), min(len(text), b + self.surround)
            while lo > 0 and not text[lo - 1].isspace() and a - lo < self.surround + 30:
                lo -= 1
            while hi < len(text) and not text[hi].isspace() and hi - b < self.surround + 30:
                hi += 1
            if out and lo <= out[-1].end and hi - out[-1].start <= self.maxchars:
                out[-1].end = max(out[-1].end, hi)
                out[-1].matches.append((a, b, t))
            else:
                out.append(Fragment(max(lo, out[-1].end) if out else lo, hi, [(a, b, t)]))
        return out


@dataclass
class PinpointFragmenter:
    """Fragments by the matches' character offsets alone: from one match to the last that still fits, with an even margin,
    trimmed to white space where there is some."""

    maxchars: int = 200
    surround: int = 20
    trim: bool = True

    def fragments(self, text: str, matches: list[tuple[int, int, str]]) -> list[Fragment]:
        out: list[Fragment] = []
        i = 0
        while i < len(matches):
            j = i
            while j + 1 < len(matches) and matches[j + 1][1] - matches[i][0] <= self.maxchars - 2 * self.surround:
                j += 1
            a, b = matches[i][0], max(m[1] for m in matches[i : j + 1])
            lo, hi = max(a - self.surround, out[-1].end if out else 0), min(matches[j + 1][0] if j + 1 < len(matches) else len(text), b + self.surround)
            if self.trim:
                if 0 < lo < a and not text[lo - 1].isspace():
                    lo = next((k + 1 for k in range(lo, a) if text[k].isspace()), lo)
                if b < hi < len(text) and not text[hi].isspace():
                    hi = next((k for k in range(hi, b, -1) if text[k].isspace()), hi)
            out.append(Fragment(lo, hi, matches[i : j + 1]))
            i = j + 1
        return out


def offsets(text: Column, expression: str = WORD, lower: bool = True) -> Column:
    """array<struct<t, pos, startchar, endchar>>: words with their places in the text, in Arrow batches; Python holds the
    words of one text at a time."""

    @F.arrow_udf("array<struct<t:string,pos:int,startchar:int,endchar:int>>")
    def run(c: pa.Array) -> pa.Array:
        every = regex.compile(expression)
        words, sizes, places = [], np.zeros(len(c), "int64"), array("i")
        for k, text in enumerate(c):
            if not text.is_valid:
                continue
            own = []
            for i, m in enumerate(every.finditer(text.as_py())):
                own.append(m[0].lower() if lower else m[0])
                places.extend((i, *m.span()))
            sizes[k] = len(own)
            words.append(pa.array(own, pa.string()))
        pos, start, end = np.frombuffer(places, "int32").reshape(-1, 3).T if places else np.zeros((3, 0), "int32")
        t = pa.concat_arrays(words) if words else pa.array([], pa.string())
        rows = pa.StructArray.from_arrays([t, *(pa.array(np.ascontiguousarray(x)) for x in (pos, start, end))], ["t", "pos", "startchar", "endchar"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), rows, mask=c.is_null())

    return run(text)


@dataclass
class EventFormatter:
    """Fragments as a stream of markup events for template engines: ("TEXT", text), ("START", (tag, class)), ("END", tag)."""

    tag: str = "strong"
    classname: str = "match"
    between: str = "..."

    def write(self, text: str, fragments: list[Fragment]) -> list[tuple[str, object]]:
        out: list[tuple[str, object]] = []
        for k, f in enumerate(fragments):
            if k:
                out.append(("TEXT", self.between))
            at = f.start
            for a, b, _ in f.matches:
                if a >= at:
                    out += [("TEXT", text[at:a])] if a > at else []
                    out += [("START", (self.tag, self.classname)), ("TEXT", text[a:b]), ("END", self.tag)]
                    at = b
            out += [("TEXT", text[at : f.end])] if f.end > at else []
        return out


@dataclass
class HtmlFormatter:
    tag: str = "strong"
    between: str = "..."
    classname: str = "match"
    termclass: str = "term"

    def write(self, text: str, fragments: list[Fragment]) -> str:
        seen: dict[str, int] = {}

        def one(piece: str, term: str) -> str:
            k = seen.setdefault(term, len(seen))
            return f'<{self.tag} class="{self.classname} {self.termclass}{k}">{html.escape(piece)}</{self.tag}>'

        return _written(text, fragments, one, self.between, html.escape)


@dataclass
class UppercaseFormatter:
    between: str = "..."

    def write(self, text: str, fragments: list[Fragment]) -> str:
        return _written(text, fragments, lambda piece, term: piece.upper(), self.between, str)


@dataclass
class NullFormatter:
    between: str = "..."

    def write(self, text: str, fragments: list[Fragment]) -> str:
        return _written(text, fragments, lambda piece, term: piece, self.between, str)


def _written(text: str, fragments: list[Fragment], one: Callable[[str, str], str], between: str, plain: Callable[[str], str]) -> str:
    out = []
    for f in fragments:
        s, at = "", f.start
        for a, b, t in f.matches:
            if a >= at:
                s += plain(text[at:a]) + one(text[a:b], t)
                at = b
        out.append(s + plain(text[at : f.end]))
    return between.join(out)


def basic_score(f: Fragment) -> float:
    """Matches, and a hundred for each different term."""
    return len(f.matches) + 100.0 * len({t for _, _, t in f.matches})


ORDERS: dict[str, Callable[[Fragment], float]] = {"first": lambda f: f.start, "score": lambda f: 0, "longer": lambda f: f.start - f.end, "shorter": lambda f: f.end - f.start}


def top_fragments(fragments: list[Fragment], count: int, order: str = "first", minscore: float = 1) -> list[Fragment]:
    """The best ones; of equals the later ones, in the order asked for."""
    best = sorted(((basic_score(f), f.start, f) for f in fragments if basic_score(f) >= minscore), key=lambda x: (x[0], x[1]), reverse=True)[:count]
    return sorted((f for _, _, f in best), key=ORDERS[order])


class Highlighter:
    def __init__(self, fragmenter=None, formatter=None, order: str = "first", top: int = 3, minscore: float = 1, expression: str = WORD):
        self.fragmenter, self.formatter = fragmenter or ContextFragmenter(), formatter or HtmlFormatter()
        self.order, self.top, self.minscore, self.expression = order, top, minscore, expression

    def matches(self, text: str, known: Callable[[str], str | None], phrases: list[tuple[str, ...]] = ()) -> list[tuple[int, int, str]]:
        """(start, end, term) of each token that known() takes; words of phrases only where the phrase stands."""
        tokens = [(m.start(), m.end(), known(m[0])) for m in regex.finditer(self.expression, text)]
        if phrases:
            only = {w for p in phrases for w in p}
            ok = set()
            for p in phrases:
                n = len(p)
                for i in range(len(tokens) - n + 1):
                    if tuple(t for _, _, t in tokens[i : i + n]) == p:
                        ok |= set(range(i, i + n))
            tokens = [(a, b, t if t not in only or i in ok else None) for i, (a, b, t) in enumerate(tokens)]
        return [(a, b, t) for a, b, t in tokens if t is not None]

    def excerpt(self, text: str, known: Callable[[str], str | None], phrases: list[tuple[str, ...]] = ()) -> str:
        found = self.matches(text, known, phrases)
        return self.formatter.write(text, top_fragments(self.fragmenter.fragments(text, found), self.top, self.order, self.minscore))

    def column(self, text: Column, terms: Iterable[str], analyzer: Analyzer | None = None, phrases: list[tuple[str, ...]] = ()) -> Column:
        """Excerpts of a text column; words are brought to terms by the analyzer's lower-casing and stemming steps."""
        wanted, me = frozenset(terms), self
        steps = analyzer.parts() if analyzer else [LowercaseFilter()]
        lower = any(isinstance(s, LowercaseFilter) for s in steps)
        maps = [s.fn for s in steps if isinstance(s, MapFilter)]

        def known(word: str) -> str | None:
            w = word.lower() if lower else word
            for fn in maps:
                w = fn(w)
            return w if w in wanted else None

        @F.arrow_udf("string")
        def run(c: pa.Array) -> pa.Array:
            return pa.array([None if t is None else me.excerpt(t, known, phrases) for t in c.to_pylist()], pa.string())

        return run(text)


def highlights(results, field: str, highlighter: Highlighter | None = None, strict_phrase: bool = False) -> DataFrame:
    """(doc_id, rank, excerpt) of the kept hits."""
    q: Q.Query = results.q
    terms = {t for f, t in q.all_terms() if f == field}
    phrases = [x.words for x in q.leaves() if isinstance(x, Q.Phrase) and x.field == field] if strict_phrase else []
    rows = results.fields(field)
    excerpt = (highlighter or Highlighter()).column(F.col(field), terms, results.searcher.corpus.kind(field).analyzer, phrases)
    return rows.select("doc_id", "rank", excerpt.alias("excerpt"))
