"""Query strings to query trees.

Supported, each by a plugin that can be left out: words, 'quoted literals', "phrases"~2, ("sequences" of anything)~2,
field:word and field:(group), AND OR NOT ANDNOT ANDMAYBE REQUIRE, (groups), prefix*, wild?card*, r"regex", fuzzy~2/1,
boost^2.5, [a TO b] and {a TO b}, field:>10, *:*, field:*, +required -banned.

The text is cut into marked nodes by the plugins' expressions, and the nodes are put together from the innermost group out.
Operators bind in the order NOT, AND, OR, ANDNOT, ANDMAYBE, REQUIRE; words side by side are joined by the parser's group.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dc_field
from typing import Any

from pyspark.sql import SparkSession

from wordloom.functions.formats import FieldType, Schema
from wordloom.operators import query as Q

ALL = frozenset("quote phrase sequence field operators group prefix wildcard regex fuzzy boost range every plusminus gtlt".split())
DEFAULT = ALL - {"regex", "fuzzy", "plusminus", "gtlt", "sequence"}


class QueryParserError(ValueError):
    pass


@dataclass
class Node:
    """kind: word, op, open, close, field, plus, minus, boost, or query (done)."""

    kind: str
    text: str = ""
    field: str | None = None
    boost: float = 1.0
    query: Q.Query | None = None
    extra: Any = None
    at: tuple[int, int] = (0, 0)
    kids: list[Node] = dc_field(default_factory=list)


def error_node(message: str, at: tuple[int, int] = (0, 0)) -> Node:
    """A node for text that can't be read: it becomes a query that matches nothing and says why."""
    return Node("query", query=Q.error_query(message), at=at)


def regex_tagger(expression: str, made: Callable[[re.Match], Q.Query | Node]) -> Callable[[str, int], Node | None]:
    """A tagger for what an expression matches; made gives a query, or a node of another kind."""
    pattern = re.compile(expression, re.S)

    def tag(text: str, at: int) -> Node | None:
        m = pattern.match(text, at)
        if m is None or m.end() == at:
            return None
        try:
            x = made(m)
        except QueryParserError as e:
            return error_node(str(e), m.span())
        if isinstance(x, Node):
            x.at = m.span()
            return x
        return Node("query", query=x, at=m.span())

    return tag


def rewrite_prefix(kind: str, made: Callable[[Node], Node]) -> Callable[[list[Node]], list[Node]]:
    """A filter for an operator before its operand: nodes of a kind and what follows them become one node."""
    def run(nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        for x in reversed(nodes):
            out.append(made(out.pop()) if x.kind == kind and out else x)
        return out[::-1]

    return run


def rewrite_postfix(kind: str, made: Callable[[Node], Node]) -> Callable[[list[Node]], list[Node]]:
    """A filter for an operator behind its operand."""
    def run(nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        for x in nodes:
            out.append(made(out.pop()) if x.kind == kind and out else x)
        return out

    return run


_OPS = ("ANDNOT", "ANDMAYBE", "REQUIRE", "AND", "OR", "NOT")


class QueryParser:
    """plugins: names from ALL. group: how words side by side combine (Q.And or Q.Or, or a function of a tuple of queries)."""

    def __init__(self, fieldname: str | None, schema: Schema | None, spark: SparkSession | None = None, plugins: frozenset[str] | set[str] = DEFAULT, group: Callable[..., Q.Query] = Q.And, termclass: Callable[..., Q.Query] = Q.Term, phraseclass: Callable[..., Q.Query] = Q.Phrase, aliases: dict[str, str] | None = None, copies: dict[str, str] | None = None, pseudo: dict[str, Callable[[Q.Query], Q.Query]] | None = None, dates: Any = None, functions: dict[str, Callable] | None = None):
        self.fieldname, self.schema, self.spark, self.plugins, self.group = fieldname, schema, spark, frozenset(plugins), group
        self.termclass, self.phraseclass = termclass, phraseclass
        self.aliases, self.copies, self.pseudo, self.dates, self.functions = aliases or {}, copies or {}, pseudo or {}, dates, functions or {}
        self.taggers: list[Callable[[str, int], Node | None]] = []
        self.filters: list[tuple[int, Callable[[list[Node]], list[Node]]]] = []
        self._analyzed: dict[tuple[str, str], list[str]] = {}

    def add_plugins(self, *names: str) -> QueryParser:
        self.plugins |= set(names)
        return self

    def remove_plugins(self, *names: str) -> QueryParser:
        self.plugins -= set(names)
        return self

    def add_tagger(self, tagger: Callable[[str, int], Node | None]) -> QueryParser:
        """A function of the text and a place that gives a node (its `at` says how far it reaches) or None; tried before all else."""
        self.taggers.append(tagger)
        return self

    def add_filter(self, fn: Callable[[list[Node]], list[Node]], priority: int = 0) -> QueryParser:
        """A function that rewrites the nodes between tagging and building the tree; lower priorities first."""
        self.filters.append((priority, fn))
        return self

    def filterize(self, nodes: list[Node]) -> list[Node]:
        for _, fn in sorted(self.filters, key=lambda x: x[0]):
            nodes = fn(nodes)
        return nodes

    def process(self, text: str) -> list[Node]:
        """The nodes that the tree is built from."""
        return self.filterize(self.tag(text))

    # text to nodes

    def tag(self, text: str) -> list[Node]:
        p, out, i, n = self.plugins, [], 0, len(text)

        def take(pattern: str) -> re.Match | None:
            return re.compile(pattern, re.S).match(text, i)

        while i < n:
            own = next((x for tagger in self.taggers if (x := tagger(text, i)) is not None), None)
            if own is not None:
                if own.at[1] <= i:
                    raise QueryParserError(f"a tagger read nothing at {i}")
                out.append(own)
                i = own.at[1]
                continue
            start_of_word = i == 0 or text[i - 1] in " \t\r\n(" or out and out[-1].kind in ("field", "plus", "minus")
            if m := take(r"\s+"):
                out.append(Node("space", at=m.span()))
            elif "operators" in p and start_of_word and (m := take(rf"({'|'.join(_OPS)})(?=[\s(]|$)")):
                out.append(Node("op", m[1], at=m.span()))
            elif "every" in p and (m := take(r"\*:\*")):
                out.append(Node("query", query=Q.Every(), at=m.span()))
            elif "field" in p and (m := take(r"(\w+|[*]):(?=\S)")) and (m[1] == "*" or self._known(m[1])):
                out.append(Node("field", m[1], at=m.span()))
            elif "gtlt" in p and out and out[-1].kind == "field" and (m := take(r"(>=|<=|>|<|=>|=<)\s*([^\s()]+)")):
                out.append(Node("gtlt", m[2], extra=m[1].replace("=>", ">=").replace("=<", "<="), at=m.span()))
            elif "functions" in p and start_of_word and (m := take(r"#(\w+)(?:\[(.*?)\])?")) and m[1] in self.functions:
                out.append(Node("query", query=self.functions[m[1]](*[a.strip() for a in (m[2] or "").split(",") if a.strip()]), at=m.span()))
            elif "regex" in p and start_of_word and (m := take(r'r"([^"]*)"')):
                out.append(Node("regex", m[1], at=m.span()))
            elif "quote" in p and start_of_word and (m := take(r"'([^']*)'(?=[\s\]})^]|$)")):
                out.append(Node("literal", m[1], at=m.span()))
            elif "sequence" in p and (m := take(r'"([^"]*)"(?:~(\d+))?')):
                out.append(Node("sequence", m[1], extra=int(m[2] or 1), at=m.span()))
            elif "phrase" in p and (m := take(r'"([^"]*)"(?:~(\d+))?')):
                out.append(Node("phrase", m[1], extra=int(m[2] or 1), at=m.span()))
            elif "range" in p and (m := take(r"([\[{])\s*(?:'([^']*)'|([^\]}]*?))?\s*\bTO\b\s*(?:'([^']*)'|([^\]}]*?))?\s*([\]}])")):
                out.append(Node("range", extra=(m[2] or m[3] or None, m[4] or m[5] or None, m[1] == "{", m[6] == "}"), at=m.span()))
            elif "group" in p and text[i] in "()":
                m = take(r"[()]")
                out.append(Node("open" if m[0] == "(" else "close", at=m.span()))
            elif "boost" in p and out and out[-1].kind not in ("space", "open", "op", "field") and (m := take(r"\^(\d+(?:\.\d+)?)(?=[\s)]|$)")):
                out.append(Node("boost", boost=float(m[1]), at=m.span()))
            elif "plusminus" in p and start_of_word and (m := take(r"[+-](?=\S)")):
                out.append(Node("plus" if m[0] == "+" else "minus", at=m.span()))
            elif "fuzzy" in p and (m := take(r"([^\s()^~\"]+)~(\d)?(?:/(\d+))?(?=[\s)^]|$)")):
                out.append(Node("fuzzy", m[1], extra=(int(m[2] or 1), int(m[3] or 0)), at=m.span()))
            else:
                stop = r"[^\s()\"]" if "group" in p else r"[^\s\"]"
                m = take(rf"(?:(?!\^\d+(?:\.\d+)?(?:[\s)]|$)){stop})+") or take(r".")
                out.append(Node("word", m[0], at=m.span()))
            i = out[-1].at[1]
        return [x for x in out if x.kind != "space"]

    def _known(self, name: str) -> bool:
        return self.schema is None or name in self.schema or name in self.aliases or name in self.pseudo or name in self.copies

    # nodes to a tree

    def parse(self, text: str, normalize: bool = True) -> Q.Query:
        nodes = self._nested(self.process(text))
        q = self._together(nodes, self.fieldname)
        return q.normalize() if normalize else q

    def _nested(self, flat: list[Node]) -> list[Node]:
        """Groups as nodes with kids; a bracket without its other half is left out, as is a group's end never reached."""
        stack: list[list[Node]] = [[]]
        for x in flat:
            if x.kind == "open":
                stack.append([])
            elif x.kind == "close":
                if len(stack) > 1:
                    kids = stack.pop()
                    stack[-1].append(Node("group", kids=kids, at=x.at))
            else:
                stack[-1].append(x)
        while len(stack) > 1:
            kids = stack.pop()
            stack[-1].append(Node("group", kids=kids))
        return stack[0]

    def _together(self, nodes: list[Node], name: str | None) -> Q.Query:
        items: list[Q.Query | str] = []
        signs: list[str] = []
        i = 0
        while i < len(nodes):
            x = nodes[i]
            at, sign = name, ""
            if x.kind in ("plus", "minus"):
                sign = x.kind
                i += 1
                if i >= len(nodes):
                    break
                x = nodes[i]
            if x.kind == "field":
                at = x.text
                i += 1
                if i >= len(nodes) or nodes[i].kind in ("op", "boost", "space"):
                    q = self._word(name, f"{x.text}:")
                    i -= 1
                    x = nodes[i]
                else:
                    x = nodes[i]
                    q = self._one(x, at)
            elif x.kind == "op":
                items.append(x.text)
                signs.append("")
                i += 1
                continue
            elif x.kind == "boost":
                i += 1
                continue
            else:
                q = self._one(x, at)
            while i + 1 < len(nodes) and nodes[i + 1].kind == "boost":
                q = Q.scaled(q, nodes[i + 1].boost)
                i += 1
            items.append(q)
            signs.append(sign)
            i += 1
        if any(signs):
            real = [(q, s) for q, s in zip(items, signs) if not isinstance(q, str)]
            return self._signed(real)
        return self._operators(items)

    def _signed(self, items: list[tuple[Q.Query, str]]) -> Q.Query:
        need, ban = [q for q, s in items if s == "plus"], [q for q, s in items if s == "minus"]
        may = [q for q, s in items if not s]
        base = self.group(tuple(may)) if may else None
        if need:
            must = Q.And(tuple(need))
            base = Q.AndMaybe(must, base) if base is not None else must
        base = base if base is not None else Q.Every()
        return Q.AndNot(base, Q.Or(tuple(ban))) if ban else base

    def _operators(self, items: list[Q.Query | str]) -> Q.Query:
        items = list(items)
        k = len(items) - 1
        while k >= 0:  # NOT binds what follows, the innermost first
            if items[k] == "NOT":
                if k + 1 < len(items) and not isinstance(items[k + 1], str):
                    items[k : k + 2] = [Q.Not(items[k + 1])]
                else:
                    del items[k]
            k -= 1
        for op in ("AND", "OR", "ANDNOT", "ANDMAYBE", "REQUIRE"):
            k = 0
            while k < len(items):
                if items[k] != op:
                    k += 1
                    continue
                left = items[k - 1] if k > 0 and not isinstance(items[k - 1], str) else None
                right = items[k + 1] if k + 1 < len(items) and not isinstance(items[k + 1], str) else None
                if left is None or right is None:
                    del items[k]
                    continue
                if op in ("AND", "OR"):
                    kind = Q.And if op == "AND" else Q.Or
                    made: Q.Query = kind((*left.subs, right)) if type(left) is kind and getattr(left, "boost", 1) == 1 and getattr(left, "_open", False) else kind((left, right))
                    object.__setattr__(made, "_open", True)
                else:
                    made = {"ANDNOT": Q.AndNot, "ANDMAYBE": Q.AndMaybe, "REQUIRE": Q.Require}[op](left, right)
                items[k - 1 : k + 2] = [made]
        qs = [q for q in items if not isinstance(q, str)]
        if not qs:
            return Q.NullQuery()
        return qs[0] if len(qs) == 1 else self.group(tuple(qs))

    def _one(self, x: Node, name: str | None) -> Q.Query:
        if x.kind == "query":
            return x.query
        if x.kind == "group":
            return self._together(x.kids, name)
        if name in self.pseudo:
            return self.pseudo[name](self._one(x, self.fieldname))
        if name in self.copies:
            target = self.copies[name]
            return Q.Or((self._plain(x, name), self._plain(x, target)))
        return self._plain(x, self.aliases.get(name, name))

    def _plain(self, x: Node, name: str | None) -> Q.Query:
        if x.kind == "word" and x.text == "*" and name:
            return Q.Every(None if name == "*" else name)
        kind = self._kind(name)
        if x.kind == "word":
            if "wildcard" in self.plugins and re.search(r"[*?]|\[[^\]]+\]", x.text) and (kind is None or kind.indexed):
                return Q.Wildcard(name, self._lower(kind, x.text)).normalize() if "prefix" in self.plugins or not x.text.endswith("*") else Q.Wildcard(name, x.text)
            return self._word(name, x.text)
        if x.kind == "literal":
            return self._word(name, x.text)
        if x.kind == "phrase":
            return self._phrase(name, x.text, x.extra)
        if x.kind == "sequence":
            inner = self._nested(self.tag(x.text))
            return Q.SpanNear(tuple(self._one(y, name) for y in inner if y.kind not in ("op", "boost")), x.extra).normalize()
        if x.kind == "regex":
            return Q.Regex(name, x.text)
        if x.kind == "fuzzy":
            return Q.FuzzyTerm(name, self._lower(kind, x.text), maxdist=x.extra[0], prefixlength=x.extra[1])
        if x.kind == "range":
            return self._range(name, *x.extra)
        if x.kind == "gtlt":
            ends = {">": (x.text, None, True, False), ">=": (x.text, None, False, False), "<": (None, x.text, False, True), "<=": (None, x.text, False, False)}
            return self._range(name, *ends[x.extra])
        return Q.NullQuery(f"can't read {x.kind}")

    def _kind(self, name: str | None) -> FieldType | None:
        return self.schema[name] if self.schema is not None and name is not None and name in self.schema else None

    @staticmethod
    def _lower(kind: FieldType | None, text: str) -> str:
        from wordloom.functions.analysis import LowercaseFilter

        return text.lower() if kind is None or any(isinstance(s, LowercaseFilter) for s in kind.analyzer.parts()) else text

    def _terms(self, name: str, text: str) -> list[str]:
        kind = self._kind(name)
        if kind is None or self.spark is None:
            return [text]
        key = (name, text)
        if key not in self._analyzed:
            self._analyzed[key] = kind.analyzer.analyze(self.spark, text, "query")
        return self._analyzed[key]

    def _word(self, name: str | None, text: str) -> Q.Query:
        kind = self._kind(name)
        if kind is not None and not kind.indexed:
            return self._value(name, kind, text)
        terms = self._terms(name, text)
        if not terms:
            return Q.NullQuery()
        if len(terms) == 1:
            return self.termclass(name, terms[0])
        how = kind.multitoken if kind else "default"
        if how == "first":
            return self.termclass(name, terms[0])
        if how == "phrase":
            return self.phraseclass(name, tuple(terms))
        many = tuple(self.termclass(name, t) for t in terms)
        return Q.Or(many) if how == "or" else Q.And(many) if how == "and" else self.group(many)

    def _phrase(self, name: str | None, text: str, slop: int) -> Q.Query:
        kind = self._kind(name)
        if kind is not None and not kind.indexed:
            return self._value(name, kind, text)
        terms = self._terms(name, text) if self.spark is not None and kind is not None else text.split()
        return Q.Phrase(name, tuple(terms), slop).normalize() if self.phraseclass is Q.Phrase else self.phraseclass(name, tuple(terms))

    def _value(self, name: str, kind: FieldType, text: str) -> Q.Query:
        """Text for a column: a number, a truth value, a date or a span of time."""
        if kind.boolean:
            t = text.lower()
            if t in ("t", "true", "yes", "1"):
                return Q.ColumnQuery(name, True)
            return Q.ColumnQuery(name, False) if t in ("f", "false", "no", "0") else Q.NullQuery(f"{text!r} is neither true nor false")
        if kind.numeric:
            try:
                v = kind.options["type"](text)
            except ValueError:
                return Q.NullQuery(f"{text!r} is no number")
            return Q.NumericRange(name, v, v)
        if kind.dated:
            span = self._dates().parse(text)
            return Q.DateRange(name, *span) if span else Q.NullQuery(f"{text!r} is no date")
        return Q.ColumnQuery(name, text)

    def _dates(self) -> Any:
        if self.dates is None:
            from wordloom.plans.dates import DateParser

            self.dates = DateParser()
        return self.dates

    def _range(self, name: str, start: str | None, end: str | None, startexcl: bool, endexcl: bool) -> Q.Query:
        kind = self._kind(name)
        if kind is not None and kind.numeric:
            try:
                a, b = (None if v is None else kind.options["type"](v) for v in (start, end))
            except ValueError:
                return Q.NullQuery(f"{start!r} or {end!r} is no number")
            return Q.NumericRange(name, a, b, startexcl, endexcl)
        if kind is not None and kind.dated:
            a, b = (None if v is None else self._dates().parse(v) for v in (start, end))
            if start is not None and a is None or end is not None and b is None:
                return Q.NullQuery(f"{start!r} or {end!r} is no date")
            first = a and (a[1] if startexcl else a[0])
            last = b and (b[0] if endexcl else b[1])
            return Q.DateRange(name, first, last, startexcl, endexcl)
        one = lambda v: None if v is None else (self._terms(name, v) or [v])[0]
        return Q.TermRange(name, one(start), one(end), startexcl, endexcl)


class MultifieldParser(QueryParser):
    """Words without a field are looked for in several, with boosts."""

    def __init__(self, fieldnames: list[str], schema: Schema | None, spark: SparkSession | None = None, fieldboosts: dict[str, float] | None = None, **how: Any):
        super().__init__(None, schema, spark, **how)
        self.fieldnames, self.boosts = fieldnames, fieldboosts or {}
        self.join: Callable[[tuple[Q.Query, ...]], Q.Query] = Q.Or

    def _one(self, x: Node, name: str | None) -> Q.Query:
        if name is None and x.kind not in ("group", "query"):
            return self.join(tuple(Q.scaled(super(MultifieldParser, self)._one(x, f), self.boosts.get(f, 1.0)) for f in self.fieldnames)).normalize()
        return super()._one(x, name)


def SimpleParser(fieldname: str, schema: Schema | None, spark: SparkSession | None = None) -> QueryParser:
    """Only words, phrases, + and -; words side by side are alternatives."""
    return QueryParser(fieldname, schema, spark, frozenset({"phrase", "plusminus"}), Q.Or)


def DisMaxParser(fieldboosts: dict[str, float], schema: Schema | None, spark: SparkSession | None = None, tiebreak: float = 0.0) -> MultifieldParser:
    p = MultifieldParser(list(fieldboosts), schema, spark, fieldboosts, plugins=frozenset({"phrase", "plusminus"}), group=Q.Or)
    p.join = lambda qs: Q.DisjunctionMax(qs, tiebreak=tiebreak)
    return p
