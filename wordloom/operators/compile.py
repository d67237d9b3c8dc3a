"""From a query tree to one DataFrame plan.

The tree's leaves that ask for terms are collected, the postings of all of them read in one pass a field, and drawn
together by document once: for each leaf whether it matched, its score, and its places where the tree asks for them. The
tree itself is then an expression over that row, however deep it is. Predicates on columns join the documents' own row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators import query as Q
from wordloom.operators import spans
from wordloom.operators.scoring import BM25F, Stats, Weighting
from wordloom.sources.corpus import Corpus, term_info

ZERO = F.lit


@dataclass
class Leaf:
    field: str
    where: Callable[[Column], Column]
    boost: float
    constant: bool
    weighting: Weighting
    spans: bool


@dataclass
class Node:
    """match, score, and places: columns; own: it can't match without one of the term leaves."""

    match: Column
    score: Column
    places: Column
    own: bool


@dataclass
class Compiler:
    corpus: Corpus
    weighting: Weighting
    scored: bool = True
    leaves: list[Leaf] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)
    flags: list[DataFrame] = field(default_factory=list)
    columns: bool = False

    def leaf(self, name: str, where: Callable[[Column], Column], boost: float, constant: bool, weighting: Weighting, places: bool) -> Node:
        k = len(self.leaves)
        self.leaves.append(Leaf(name, where, boost, constant, weighting, places))
        return Node(F.coalesce(F.col(f"m{k}"), F.lit(False)), F.coalesce(F.col(f"s{k}"), F.lit(0.0)), spans.of_positions(F.col(f"p{k}")) if places else spans.none(), True)

    def frame(self, df: DataFrame, boost: float = 1.0) -> Node:
        k = len(self.frames)
        self.frames.append(df.select("doc_id", F.col("score").cast("double").alias(f"f{k}")))
        return Node(F.col(f"f{k}").isNotNull(), F.coalesce(F.col(f"f{k}"), F.lit(0.0)) * boost, spans.none(), False)

    def of_column(self, condition: Column, score: float) -> Node:
        self.columns = True
        ok = F.coalesce(condition, F.lit(False))
        return Node(ok, F.when(ok, F.lit(float(score))).otherwise(F.lit(0.0)), spans.none(), False)

    def walk(self, q: Q.Query, w: Weighting, places: bool = False) -> Node:
        if isinstance(q, Q.NullQuery):
            return Node(F.lit(False), F.lit(0.0), spans.none(), True)
        if isinstance(q, Q.Every):
            if q.field is None:
                return self.of_column(F.lit(True), q.boost)
            if not self.corpus.kind(q.field).indexed:
                return self.of_column(F.col(q.field).isNotNull(), q.boost)
            return self.leaf(q.field, lambda t: F.lit(True), q.boost, True, w, False)
        if isinstance(q, Q.Term):
            kind = self.corpus.kind(q.field)
            if not kind.indexed:
                return self.of_column(F.col(q.field) == F.lit(q.text), q.boost)
            return self.leaf(q.field, lambda t: t == q.text, q.boost, False, w, places)
        if isinstance(q, Q.MultiTerm):
            where, constant = self.expand(q), q.constantscore
            return self.leaf(q.field, where, q.boost, constant, w, places)
        if isinstance(q, Q.TermRange):
            return self.leaf(q.field, lambda t: between(t, q), q.boost, q.constantscore, w, places)
        if isinstance(q, Q.NumericRange):
            return self.of_column(between(F.col(q.field), q), q.boost)
        if isinstance(q, Q.ColumnQuery):
            c = F.col(q.field)
            return self.of_column(q.condition(c) if callable(q.condition) else c == F.lit(q.condition), 1.0)
        if isinstance(q, Q.Rows):
            return self.frame(q.frame)
        if isinstance(q, Q.And):
            kids = [self.walk(c, w, places) for c in q.subs]
            score = sum((k.score for k, c in zip(kids, q.subs) if not isinstance(c, Q.Not)), F.lit(0.0)) * q.boost
            return Node(reduce(lambda a, b: a & b, (k.match for k in kids)), score, _both(kids, places), any(k.own for k in kids))
        if isinstance(q, Q.Or):
            kids = [self.walk(c, w, places) for c in q.subs]
            return self.any_of(q, kids, places)
        if isinstance(q, Q.DisjunctionMax):
            kids = [self.walk(c, w, places) for c in q.subs]
            got = [F.when(k.match, k.score) for k in kids]
            top = F.coalesce(F.greatest(*got) if len(got) > 1 else got[0], F.lit(0.0))
            rest = sum((F.coalesce(g, F.lit(0.0)) for g in got), F.lit(0.0)) - top
            return Node(reduce(lambda a, b: a | b, (k.match for k in kids)), (top + q.tiebreak * rest) * q.boost, _union(kids, places), all(k.own for k in kids))
        if isinstance(q, Q.AndNot):
            a, b = self.walk(q.a, w, places), self.walk(q.b, w)
            return Node(a.match & ~b.match, a.score * q.boost, a.places, a.own)
        if isinstance(q, Q.AndMaybe):
            a, b = self.walk(q.a, w, places), self.walk(q.b, w)
            return Node(a.match, (a.score + F.when(b.match, b.score).otherwise(0.0)) * q.boost, a.places, a.own)
        if isinstance(q, Q.Require):
            a, b = self.walk(q.a, w, places), self.walk(q.b, w)
            return Node(a.match & b.match, a.score * q.boost, a.places, a.own or b.own)
        if isinstance(q, Q.Otherwise):
            k = len(self.flags)
            first = compiled(q.a, self.corpus, self.weighting, scored=False).limit(1)
            self.flags.append(first.agg((F.count(F.lit(1)) > 0).alias(f"any{k}")))  # one row
            any_of, a, b = F.col(f"any{k}"), self.walk(q.a, w, places), self.walk(q.b, w, places)
            pick = lambda x, y: F.when(any_of, x).otherwise(y)
            return Node(pick(a.match, b.match), pick(a.score, b.score), pick(a.places, b.places) if places else spans.none(), a.own and b.own)
        if isinstance(q, Q.Not):
            k = self.walk(q.query, w)
            self.columns = True
            return Node(~k.match, F.lit(float(q.boost)), spans.none(), False)
        if isinstance(q, Q.ConstantScore):
            k = self.walk(q.query, w, places)
            return Node(k.match, F.lit(float(q.score)), k.places, k.own)
        if isinstance(q, Q.Weighted):
            return self.walk(q.query, q.weighting or w, places)
        if isinstance(q, Q.Span):
            return self.span(q, w)
        if isinstance(q, (Q.NestedParent, Q.NestedChildren)):
            from wordloom.operators.nested import children_of, parents_of

            df = (parents_of if isinstance(q, Q.NestedParent) else children_of)(self.corpus, q, w)
            return self.frame(df, q.boost)
        raise TypeError(f"no plan for {type(q).__name__}")

    def any_of(self, q: Q.Or, kids: list[Node], places: bool) -> Node:
        n = sum((k.match.cast("int") for k in kids), F.lit(0))
        score = sum((F.when(k.match, k.score).otherwise(F.lit(0.0)) for k in kids), F.lit(0.0))
        if q.scale:
            m = len(kids)
            by = (m - q.scale) ** 2
            score = (score + (n - 1) / F.lit(float(by)) if by else F.lit(0.0)) * ((m - 1) / m) if by else F.lit(0.0)
        match = n >= q.minmatch if q.minmatch > 1 else reduce(lambda a, b: a | b, (k.match for k in kids))
        return Node(match, score * q.boost, _union(kids, places), all(k.own for k in kids))

    def span(self, q: Q.Query, w: Weighting) -> Node:
        if isinstance(q, Q.Phrase):
            return self.span(Q.SpanNear(tuple(Q.Term(q.field, x) for x in q.words), q.slop, boost=q.boost), w)
        if isinstance(q, Q.SpanNear):
            kids = [self.walk(c, w, True) for c in q.subs]
            places = reduce(lambda a, b: spans.bound(spans.near, a, b, q.slop, q.ordered, q.mindist), (k.places for k in kids))
            return self.placed(places, sum((k.score for k in kids), F.lit(0.0)) * q.boost, any(k.own for k in kids))
        if isinstance(q, Q.SpanFirst):
            k = self.walk(q.query, w, True)
            return self.placed(spans.first(k.places, q.limit), k.score, k.own)
        if isinstance(q, Q.SpanOr):
            kids = [self.walk(c, w, True) for c in q.subs]
            return self.placed(spans.merged(F.concat(*(k.places for k in kids))), sum((F.when(k.match, k.score).otherwise(0.0) for k in kids), F.lit(0.0)), all(k.own for k in kids))
        a, b = self.walk(q.a, w, True), self.walk(q.b, w, True)
        if isinstance(q, Q.SpanNot):
            return self.placed(spans.bound(spans.outside, a.places, b.places), a.score, a.own)
        if isinstance(q, Q.SpanContains):
            return self.placed(spans.bound(spans.containing, a.places, b.places), a.score + b.score, True)
        if isinstance(q, Q.SpanBefore):
            return self.placed(spans.bound(spans.before, a.places, b.places), a.score + b.score, True)
        if isinstance(q, Q.SpanCondition):
            return Node(b.match & (F.size(a.places) > 0), a.score, a.places, True)
        raise TypeError(f"no plan for {type(q).__name__}")

    @staticmethod
    def placed(places: Column, score: Column, own: bool) -> Node:
        return Node(F.size(places) > 0, score, places, own)

    def expand(self, q: Q.MultiTerm) -> Callable[[Column], Column]:
        if isinstance(q, Q.Prefix):
            return lambda t: t.startswith(q.text)
        if isinstance(q, Q.Wildcard):
            p = q.pattern()
            return lambda t: t.rlike("(?s)" + p)
        if isinstance(q, Q.Regex):
            return lambda t: t.rlike(f"^(?:{q.text})")
        if isinstance(q, Q.FuzzyTerm):
            head = q.text[: q.prefixlength]
            near = lambda t: (F.abs(F.length(t) - len(q.text)) <= q.maxdist) & (F.levenshtein(t, F.lit(q.text), q.maxdist) >= 0)
            return (lambda t: t.startswith(head) & near(t)) if head else near
        if isinstance(q, Q.Variations):
            from wordloom.functions.morphology import variations

            return lambda t: t.isin(sorted(variations(q.text)))
        raise TypeError(type(q).__name__)

    # the row of each document

    def matrix(self) -> DataFrame | None:
        if not self.leaves:
            return None
        per_field: dict[str, list[int]] = {}
        for k, leaf in enumerate(self.leaves):
            per_field.setdefault(leaf.field, []).append(k)
        parts = []
        for name, own in per_field.items():
            kind = self.corpus.kind(name)
            places = any(self.leaves[k].spans for k in own)

            def any_leaf(t: Column, own: list[int] = own) -> Column:
                return reduce(lambda a, b: a | b, (self.leaves[k].where(t) for k in own))

            scores = self.scored and any(not self.leaves[k].constant for k in own)
            if scores:
                p, stats = self.corpus.matched(name, any_leaf, places)
                # as many rows as the query has terms, which AQE broadcasts by their measured size; one row of statistics
                p = p.join(term_info(p).select("term", "df", "cf"), "term").crossJoin(F.broadcast(stats))
            else:
                p = self.corpus.postings(name, any_leaf, places)
            aggs = []
            for k, leaf in enumerate(self.leaves):
                if k not in own:
                    aggs += [F.lit(None).cast("boolean").alias(f"m{k}"), F.lit(None).cast("double").alias(f"s{k}")]
                    if leaf.spans:
                        aggs.append(F.lit(None).cast("array<int>").alias(f"p{k}"))
                    continue
                hit = leaf.where(F.col("term"))
                if leaf.constant or not self.scored:
                    value = F.lit(float(leaf.boost))
                    total = F.max(F.when(hit, value))
                else:
                    s = Stats(F.col("weight"), F.col("length"), F.col("df"), F.col("cf"), F.col("n"), F.col(f"total_{name}") if kind.scorable else F.lit(1), F.col(f"avg_{name}") if kind.scorable else F.lit(1.0), name, F.col("term"), kind.scorable)
                    total = F.sum(F.when(hit, leaf.weighting.of(s) * leaf.boost))
                aggs += [F.max(hit).alias(f"m{k}"), total.alias(f"s{k}")]
                if leaf.spans:
                    aggs.append(F.array_sort(F.flatten(F.collect_list(F.when(hit, F.col("positions"))))).alias(f"p{k}"))
            real = [a for a in aggs]
            parts.append(p.groupBy("doc_id").agg(*real))
        if len(parts) == 1:
            return parts[0]
        every = reduce(DataFrame.unionByName, parts)
        names = [c for c in every.columns if c != "doc_id"]
        return every.groupBy("doc_id").agg(*(F.max(c).alias(c) if c[0] == "m" else F.first(c, ignorenulls=True).alias(c) for c in names))


def _both(kids: list[Node], places: bool) -> Column:
    return F.array_sort(F.concat(*(k.places for k in kids))) if places else spans.none()


def _union(kids: list[Node], places: bool) -> Column:
    return F.array_sort(F.concat(*(F.when(k.match, k.places).otherwise(spans.none()) for k in kids))) if places else spans.none()


def between(c: Column, q: Q.TermRange | Q.NumericRange) -> Column:
    ok = c.isNotNull()
    if q.start is not None:
        ok &= c > F.lit(q.start) if q.startexcl else c >= F.lit(q.start)
    if q.end is not None:
        ok &= c < F.lit(q.end) if q.endexcl else c <= F.lit(q.end)
    return ok


def compiled(q: Q.Query, corpus: Corpus, weighting: Weighting | None = None, scored: bool = True, places: bool = False, matched: bool = False) -> DataFrame:
    """(doc_id, score[, places][, matched]) of every match. matched: texts of the leaves that matched, in the tree's order."""
    w = weighting or BM25F()
    c = Compiler(corpus, w, scored)
    q = q.normalize()
    node = c.walk(q, w, places)
    rows = c.matrix()
    if c.columns or rows is None and not c.frames or not node.own and rows is not None and not c.frames:
        docs = corpus.docs()
        how = "inner" if node.own else "left"
        rows = docs if rows is None else docs.join(rows, "doc_id", how)
    for f in c.frames:
        rows = f if rows is None else rows.join(f, "doc_id", "full_outer" if not c.columns else "left")
    for f in c.flags:
        rows = rows.crossJoin(F.broadcast(f))
    score = w.final(node.score) if scored else F.lit(0.0)
    out = [F.col("doc_id"), score.alias("score")]
    if places:
        out.append(node.places.alias("places"))
    if matched:
        named = [q for q in q.leaves() if isinstance(q, (Q.Term, Q.MultiTerm, Q.TermRange)) and corpus.kind(q.field).indexed]
        got = [F.when(F.coalesce(F.col(f"m{k}"), F.lit(False)), F.lit(f"{x.field}:{getattr(x, 'text', x)}")) for k, x in enumerate(named) if k < len(c.leaves)]
        out.append((F.array_compact(F.array(*got)) if got else F.array().cast("array<string>")).alias("matched"))
    return rows.where(node.match).select(*out)


def last_parent(order: str, flag: Column) -> Column:
    """The doc_id of the nearest flagged row at or before each row of its group."""
    w = Window.partitionBy("group_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(flag, F.col("doc_id")), ignorenulls=True).over(w)
