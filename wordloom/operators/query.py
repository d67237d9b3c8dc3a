"""The query tree: what to match. Trees are values; compile.py turns one into a DataFrame plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from dataclasses import field as dc_field
from typing import Any


@dataclass(frozen=True)
class Query:
    """A node. `a & b`, `a | b`, `a - b` combine nodes."""

    def __and__(self, other: Query) -> Query:
        return And((self, other)).normalize()

    def __or__(self, other: Query) -> Query:
        return Or((self, other)).normalize()

    def __sub__(self, other: Query) -> Query:
        return And((self, Not(other))).normalize()

    def children(self) -> tuple[Query, ...]:
        return ()

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return self

    def accept(self, fn: Callable[[Query], Query]) -> Query:
        """The tree rewritten from the leaves up."""
        kids = self.children()
        return fn(self.with_children(tuple(c.accept(fn) for c in kids)) if kids else self)

    def leaves(self) -> Iterator[Query]:
        kids = self.children()
        if not kids:
            yield self
        for c in kids:
            yield from c.leaves()

    def all_terms(self, phrases: bool = True) -> set[tuple[str, str]]:
        """(field, text) of every term, those of phrases with phrases."""
        out: set[tuple[str, str]] = set()
        for q in self.leaves():
            if isinstance(q, Term):
                out.add((q.field, q.text))
            elif isinstance(q, Phrase) and phrases:
                out |= {(q.field, w) for w in q.words}
        return out

    def requires(self) -> set[Query]:
        """Leaves without which nothing matches."""
        if isinstance(self, And):
            return set().union(*(c.requires() for c in self.subs)) if self.subs else set()
        if isinstance(self, Or):
            got = [c.requires() for c in self.subs]
            return set.intersection(*got) if got else set()
        if isinstance(self, (AndNot, AndMaybe)):
            return self.a.requires()
        if isinstance(self, Require):
            return self.a.requires() | self.b.requires()
        return set() if self.children() else {self}

    def replace_text(self, field: str, old: str, new: str) -> Query:
        def one(q: Query) -> Query:
            if isinstance(q, Term) and q.field == field and q.text == old:
                return replace(q, text=new)
            if isinstance(q, Phrase) and q.field == field:
                return replace(q, words=tuple(new if w == old else w for w in q.words))
            return q

        return self.accept(one)

    def normalize(self) -> Query:
        return self

    def simplify(self, corpus: Any) -> Query:
        """The tree without leaves that no document of a corpus can match: terms that it lacks."""
        have = self.existing_terms(corpus)
        return self.accept(lambda q: NullQuery() if isinstance(q, Term) and corpus.kind(q.field).indexed and (q.field, q.text) not in have else q).normalize()

    def existing_terms(self, corpus: Any) -> set[tuple[str, str]]:
        """Those of all_terms that a corpus has; one lookup a field."""
        terms = self.all_terms()
        out: set[tuple[str, str]] = set()
        for field in sorted({f for f, _ in terms if f in corpus.schema and corpus.kind(f).indexed}):
            own = [t for f, t in terms if f == field]
            out |= {(field, r["term"]) for r in corpus.terms_with(field, lambda t, own=own: t.isin(own)).select("term").collect()}  # the query's terms at most
        return out

    def estimate_size(self, corpus: Any) -> int:
        """At most so many documents match: document frequencies added up where one of several may match, the least where all must."""
        if isinstance(self, Term) and corpus.kind(self.field).indexed:
            return corpus.doc_frequency(self.field, self.text)
        if isinstance(self, And):
            return min((c.estimate_size(corpus) for c in self.subs if not isinstance(c, Not)), default=corpus.doc_count())
        if isinstance(self, (Or, DisjunctionMax)):
            return min(sum(c.estimate_size(corpus) for c in self.subs), corpus.doc_count())
        if isinstance(self, (AndNot, AndMaybe)):
            return self.a.estimate_size(corpus)
        if isinstance(self, Require):
            return min(self.a.estimate_size(corpus), self.b.estimate_size(corpus))
        return 0 if isinstance(self, NullQuery) else corpus.doc_count()

    def __str__(self) -> str:
        return self.text_form()

    def text_form(self) -> str:
        return f"<{type(self).__name__}>"


def _boosted(s: str, boost: float) -> str:
    return s if boost == 1.0 else f"{s}^{boost}"


@dataclass(frozen=True)
class NullQuery(Query):
    """Matches nothing; error says why, where a query text was at fault."""

    error: str = ""


def error_query(error: Exception | str, q: Query | None = None) -> Query:
    """A query that stands for one that can't be read; what q would match if it is given, else nothing."""
    return q if q is not None else NullQuery(str(error))


@dataclass(frozen=True)
class Every(Query):
    """All documents, or those that have a term (or value) in a field; the score is the boost."""

    field: str | None = None
    boost: float = 1.0

    def text_form(self) -> str:
        return _boosted(f"{self.field or '*'}:*", self.boost)


@dataclass(frozen=True)
class Term(Query):
    field: str
    text: str
    boost: float = 1.0

    def text_form(self) -> str:
        return _boosted(f"{self.field}:{self.text}", self.boost)


@dataclass(frozen=True)
class MultiTerm(Query):
    """Base of queries that stand for all terms of a kind. constant: every match scores the boost; else the terms' scores add up."""

    field: str
    text: str
    boost: float = 1.0
    constantscore: bool = True

    def text_form(self) -> str:
        return _boosted(f"{self.field}:{self.text}*", self.boost)


@dataclass(frozen=True)
class Prefix(MultiTerm):
    def normalize(self) -> Query:
        return Every(self.field, self.boost) if not self.text else self


@dataclass(frozen=True)
class Wildcard(MultiTerm):
    """* for any run, ? for a character, [a-c] and [!a] for sets; the whole term has to match."""

    def normalize(self) -> Query:
        if self.text == "*":
            return Every(self.field, self.boost)
        if not any(c in self.text for c in "*?["):
            return Term(self.field, self.text, self.boost)
        if self.text.endswith("*") and not any(c in self.text[:-1] for c in "*?["):
            return Prefix(self.field, self.text[:-1], self.boost, self.constantscore)
        return self

    def pattern(self) -> str:
        return glob_pattern(self.text)

    def text_form(self) -> str:
        return _boosted(f"{self.field}:{self.text}", self.boost)


def glob_pattern(glob: str) -> str:
    """A regular expression, whole to whole, of a glob; the part common to Java's and RE2's dialect."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


@dataclass(frozen=True)
class Regex(MultiTerm):
    """Terms that a regular expression matches from their start."""

    def text_form(self) -> str:
        return _boosted(f'{self.field}:r"{self.text}"', self.boost)


@dataclass(frozen=True)
class FuzzyTerm(MultiTerm):
    """Terms within an edit distance that share the first prefixlength characters."""

    maxdist: int = 1
    prefixlength: int = 1

    def text_form(self) -> str:
        return _boosted(f"{self.field}:{self.text}~{self.maxdist}", self.boost)


@dataclass(frozen=True)
class Variations(MultiTerm):
    """English forms of a word."""

    constantscore: bool = False

    def text_form(self) -> str:
        return _boosted(f"{self.field}:<{self.text}>", self.boost)


@dataclass(frozen=True)
class TermRange(Query):
    field: str
    start: str | None
    end: str | None
    startexcl: bool = False
    endexcl: bool = False
    boost: float = 1.0
    constantscore: bool = True

    def normalize(self) -> Query:
        if self.start in ("", None) and self.end in ("￿", None):
            return Every(self.field, self.boost)
        if self.start is not None and self.start == self.end:
            return NullQuery() if self.startexcl or self.endexcl else Term(self.field, self.start, self.boost)
        return self

    def text_form(self) -> str:
        return _boosted(f"{self.field}:{'{' if self.startexcl else '['}{self.start or ''} TO {self.end or ''}{'}' if self.endexcl else ']'}", self.boost)


@dataclass(frozen=True)
class NumericRange(Query):
    """Values of a numeric column between ends; a null end is open."""

    field: str
    start: Any
    end: Any
    startexcl: bool = False
    endexcl: bool = False
    boost: float = 1.0

    text_form = TermRange.text_form


@dataclass(frozen=True)
class DateRange(NumericRange):
    """The same of points in time."""


@dataclass(frozen=True)
class ColumnQuery(Query):
    """Documents whose column equals a value, or makes a function Column -> Column true; the score is 1."""

    field: str
    condition: Any


@dataclass(frozen=True)
class Compound(Query):
    subs: tuple[Query, ...] = ()
    boost: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "subs", tuple(self.subs))

    def children(self) -> tuple[Query, ...]:
        return self.subs

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, subs=new)

    def _flat(self) -> list[Query]:
        out: list[Query] = []
        for c in self.subs:
            c = c.normalize()
            if type(c) is type(self) and c.boost == 1.0 and not getattr(c, "scale", None) and not getattr(c, "minmatch", 0):
                out += c.subs
            else:
                out.append(c)
        seen: list[Query] = []
        for c in out:
            if c not in seen:
                seen.append(c)
        return seen

    def _lone(self, subs: list[Query]) -> Query:
        if len(subs) == 1:
            return scaled(subs[0], self.boost)
        return replace(self, subs=tuple(subs))

    JOIN = " "

    def text_form(self) -> str:
        return _boosted("(" + self.JOIN.join(map(str, self.subs)) + ")", self.boost)


def scaled(q: Query, by: float) -> Query:
    return replace(q, boost=q.boost * by) if by != 1.0 and hasattr(q, "boost") else q


@dataclass(frozen=True)
class And(Compound):
    JOIN = " AND "

    def normalize(self) -> Query:
        subs = self._flat()
        if any(isinstance(c, NullQuery) and not c.error for c in subs):
            return NullQuery()
        subs = [c for c in subs if not isinstance(c, NullQuery)]
        rest = [c for c in subs if not (isinstance(c, Every) and c.field is None)]
        if not subs:
            return NullQuery()
        return self._lone(rest or subs[:1])


@dataclass(frozen=True)
class Or(Compound):
    """minmatch: how many of the sub-queries have to match, at least. scale: a bonus for matching many of them."""

    minmatch: int = 0
    scale: float | None = None
    JOIN = " OR "

    def normalize(self) -> Query:
        subs = [c for c in self._flat() if not isinstance(c, NullQuery)]
        every = [c for c in subs if isinstance(c, Every) and c.field is None]
        if every and not self.minmatch:
            return scaled(every[0], self.boost)
        if not subs:
            return NullQuery()
        if self.minmatch > 1 or self.scale and len(subs) > 1:
            return replace(self, subs=tuple(subs))
        return self._lone(_merged(subs))


def _merged(subs: list[Query]) -> list[Query]:
    """Overlapping ranges of one column drawn together."""
    out: list[Query] = []
    for q in subs:
        for k, p in enumerate(out):
            if type(p) is type(q) and isinstance(q, NumericRange) and p.field == q.field and p.boost == q.boost and None not in (p.start, p.end, q.start, q.end) and not (p.startexcl or p.endexcl or q.startexcl or q.endexcl) and p.start <= q.end and q.start <= p.end:
                out[k] = replace(p, start=min(p.start, q.start), end=max(p.end, q.end))
                break
        else:
            out.append(q)
    return out


@dataclass(frozen=True)
class DisjunctionMax(Compound):
    """Any of them; the score is the largest, and tiebreak times the rest."""

    tiebreak: float = 0.0
    JOIN = " DISMAX "

    def normalize(self) -> Query:
        subs = [c for c in self._flat() if not isinstance(c, NullQuery)]
        return self._lone(subs) if subs else NullQuery()


@dataclass(frozen=True)
class Binary(Query):
    a: Query
    b: Query
    boost: float = 1.0

    def children(self) -> tuple[Query, ...]:
        return (self.a, self.b)

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, a=new[0], b=new[1])

    def text_form(self) -> str:
        return f"({self.a} {type(self).__name__.upper()} {self.b})"


@dataclass(frozen=True)
class AndNot(Binary):
    def normalize(self) -> Query:
        a, b = self.a.normalize(), self.b.normalize()
        if isinstance(a, NullQuery):
            return a
        return scaled(a, self.boost) if isinstance(b, NullQuery) else replace(self, a=a, b=b)


@dataclass(frozen=True)
class AndMaybe(Binary):
    def normalize(self) -> Query:
        a, b = self.a.normalize(), self.b.normalize()
        if isinstance(a, NullQuery):
            return b
        return scaled(a, self.boost) if isinstance(b, NullQuery) else replace(self, a=a, b=b)


@dataclass(frozen=True)
class Require(Binary):
    """Both match, the left one gives the score."""

    def normalize(self) -> Query:
        a, b = self.a.normalize(), self.b.normalize()
        return b if isinstance(a, NullQuery) else a if isinstance(b, NullQuery) else replace(self, a=a, b=b)


@dataclass(frozen=True)
class Otherwise(Binary):
    """The right one if the left matches nothing in the whole index."""


@dataclass(frozen=True)
class Not(Query):
    query: Query
    boost: float = 1.0

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, query=new[0])

    def normalize(self) -> Query:
        q = self.query.normalize()
        return NullQuery("nothing to leave out") if isinstance(q, NullQuery) else replace(self, query=q)

    def text_form(self) -> str:
        return f"NOT {self.query}"


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query
    score: float = 1.0

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, query=new[0])


@dataclass(frozen=True)
class Weighted(Query):
    """A subtree scored by another model."""

    query: Query
    weighting: Any = None

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, query=new[0])


def BooleanQuery(required: list[Query], should: list[Query], prohibited: list[Query]) -> Query:
    """All of the required, none of the prohibited, and a better score for those that should match."""
    base: Query = And(tuple(required)) if required else Or(tuple(should))
    if required and should:
        base = AndMaybe(base, Or(tuple(should)))
    return (AndNot(base, Or(tuple(prohibited))) if prohibited else base).normalize()


# Positions


@dataclass(frozen=True)
class Span(Query):
    """Base of queries that match places (first and last position) in a document."""


@dataclass(frozen=True)
class Phrase(Span):
    """Words in order, each at most slop positions after the one before."""

    field: str
    words: tuple[str, ...]
    slop: int = 1
    boost: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", tuple(self.words))

    def normalize(self) -> Query:
        if not self.words:
            return NullQuery()
        return Term(self.field, self.words[0], self.boost) if len(self.words) == 1 else self

    def text_form(self) -> str:
        return _boosted(f'{self.field}:"{" ".join(self.words)}"' + (f"~{self.slop}" if self.slop > 1 else ""), self.boost)


@dataclass(frozen=True)
class SpanNear(Span):
    """Sub-queries one near the next: mindist to slop positions from one's end to the next one's start, in any order unless ordered."""

    subs: tuple[Query, ...]
    slop: int = 1
    ordered: bool = True
    mindist: int = 1
    boost: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "subs", tuple(self.subs))

    def children(self) -> tuple[Query, ...]:
        return self.subs

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, subs=new)

    def normalize(self) -> Query:
        subs = tuple(c.normalize() for c in self.subs)
        if any(isinstance(c, NullQuery) for c in subs) or not subs:
            return NullQuery()
        return subs[0] if len(subs) == 1 else replace(self, subs=subs)


def Sequence(subs: list[Query], slop: int = 1, ordered: bool = True, boost: float = 1.0) -> SpanNear:
    return SpanNear(tuple(subs), slop, ordered, boost=boost)


def Ordered(subs: list[Query], boost: float = 1.0) -> SpanNear:
    """In order, at any distance."""
    return SpanNear(tuple(subs), 1 << 30, True, boost=boost)


@dataclass(frozen=True)
class SpanFirst(Span):
    query: Query
    limit: int = 0

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, query=new[0])


@dataclass(frozen=True)
class SpanOr(Span):
    subs: tuple[Query, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "subs", tuple(self.subs))

    def children(self) -> tuple[Query, ...]:
        return self.subs

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, subs=new)


@dataclass(frozen=True)
class SpanPair(Span):
    a: Query
    b: Query

    def children(self) -> tuple[Query, ...]:
        return (self.a, self.b)

    def with_children(self, new: tuple[Query, ...]) -> Query:
        return replace(self, a=new[0], b=new[1])


@dataclass(frozen=True)
class SpanNot(SpanPair):
    """Places of a that overlap none of b."""


@dataclass(frozen=True)
class SpanContains(SpanPair):
    """Places of a with one of b inside."""


@dataclass(frozen=True)
class SpanBefore(SpanPair):
    """Places of a that end before the first of b."""


@dataclass(frozen=True)
class SpanCondition(SpanPair):
    """Places of a in documents that b matches too."""


# Parents and children: documents of a group in order, each parent before its children


@dataclass(frozen=True)
class NestedParent(Query):
    """Parents of the children that a query matches; of a parent's children the best per_parent_limit count."""

    parents: Query
    query: Query
    per_parent_limit: int | None = None
    combine: str = "sum"
    boost: float = 1.0


@dataclass(frozen=True)
class NestedChildren(Query):
    """The documents after each parent that a query matches, up to the next parent."""

    parents: Query
    query: Query
    boost: float = 1.0


@dataclass(frozen=True)
class Rows(Query):
    """A ready-made result: a DataFrame (doc_id, score)."""

    frame: Any = dc_field(compare=False, default=None)


def token_lists(q: Query, phrases: bool = True) -> Any:
    """Terms of a tree in nested lists, as the tree nests."""
    if isinstance(q, Term):
        return q.text
    if isinstance(q, Phrase):
        return list(q.words) if phrases else []
    return [x for x in (token_lists(c, phrases) for c in q.children()) if x]
