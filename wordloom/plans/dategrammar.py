"""Parts that a language's dates are made of, to be put together to a grammar: each reads a date's parts from a text.

parse(text, at, base, got) gives (got, at) with what was read added, or None. got maps year, month, day, hour, minute,
second (what isn't named stays open), and "span" for two ends.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from wordloom.plans.dates import DateParser, Span, ceil_of, floor_of

Got = dict[str, object]
Read = tuple[Got, int] | None
PARTS = ("year", "month", "day", "hour", "minute", "second")


def _skip(text: str, at: int, between: str) -> int:
    m = re.compile(between).match(text, at)
    return m.end() if m else at


class Element:
    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        raise NotImplementedError

    def read(self, text: str, base: dt.datetime) -> Span | None:
        """First and last moment of what a whole text says."""
        r = self.parse(text.lower().strip(), 0, base, {})
        return None if r is None or r[1] < len(text.strip()) else resolved(r[0], base)


def resolved(got: Got, base: dt.datetime) -> Span | None:
    """The moments between which a date with open parts lies; open parts above a named one are those of base."""
    if "span" in got:
        return got["span"]  # type: ignore[return-value]
    if not got:
        return None
    first = min(PARTS.index(k) for k in got)
    last = max(PARTS.index(k) for k in got)
    parts = [got.get(k, getattr(base, k) if i < first or i <= last else None) for i, k in enumerate(PARTS[: last + 1])]
    try:
        return floor_of(*parts), ceil_of(*parts)  # type: ignore[arg-type]
    except ValueError:
        return None


@dataclass
class Regex(Element):
    """An expression whose named groups are numbers of parts."""

    pattern: str

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        m = re.compile(self.pattern, re.I).match(text, at)
        if m is None:
            return None
        return got | {k: int(v) for k, v in m.groupdict().items() if v is not None}, m.end()


@dataclass
class Words(Element):
    """Names of a part's values, such as months: the longest that fits."""

    part: str
    values: dict[str, int]

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        for w in sorted(self.values, key=len, reverse=True):
            if re.compile(rf"{re.escape(w)}\b").match(text, at):
                return got | {self.part: self.values[w]}, at + len(w)
        return None


@dataclass
class Spoken(Element):
    """What DateParser reads: the longest part of the text, at word ends, that it understands."""

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        ends = [m.start() for m in re.finditer(r"(?=\s)|\Z", text) if m.start() > at]
        for end in reversed(ends):
            span = DateParser(base).parse(text[at:end])
            if span:
                return got | {"span": span}, end
        return None


@dataclass
class Choice(Element):
    """The first of several elements that reads something."""

    elements: list[Element]

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        return next((r for e in self.elements if (r := e.parse(text, at, base, got)) is not None), None)


@dataclass
class Optional(Element):
    element: Element

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        return self.element.parse(text, at, base, got) or (got, at)


@dataclass
class Sequence(Element):
    """Elements one after the other, with what may stand between them."""

    elements: list[Element]
    between: str = r"(\s+|\s*,\s*)"

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        for i, e in enumerate(self.elements):
            to = _skip(text, at, self.between) if i else at
            r = e.parse(text, to, base, got)
            if r is None:
                return None
            got, at = r if r[1] > to or not i else (r[0], at)  # an empty optional part needs no gap
        return got, at


@dataclass
class Bag(Element):
    """Elements in any order, each once at most; at least `least` of them, and those of `requires` in any case."""

    elements: list[Element]
    least: int = 1
    requires: tuple[int, ...] = ()
    between: str = r"(\s+|\s*,\s*)"

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        left, seen = dict(enumerate(self.elements)), set()
        while left:
            to = _skip(text, at, self.between) if seen else at
            for i, e in left.items():
                r = e.parse(text, to, base, got)
                if r is not None and r[1] > to:
                    (got, at), _ = r, seen.add(i)
                    del left[i]
                    break
            else:
                break
        return (got, at) if len(seen) >= self.least and seen >= set(self.requires) else None


@dataclass
class Combo(Element):
    """Two dates that make a span: the first moment of the one to the last of the other."""

    first: Element
    second: Element
    between: str = r"\s*(to|until|-)\s*"

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        a = self.first.parse(text, at, base, {})
        m = re.compile(self.between).match(text, a[1]) if a else None
        b = self.second.parse(text, m.end(), base, {}) if m else None
        if b is None:
            return None
        x, y = resolved(a[0], base), resolved(b[0], base)
        return None if x is None or y is None else (got | {"span": (min(x[0], y[0]), max(x[1], y[1]))}, b[1])


@dataclass
class ToEnd(Element):
    """An element that has to reach the text's end."""

    element: Element

    def parse(self, text: str, at: int, base: dt.datetime, got: Got) -> Read:
        r = self.element.parse(text, at, base, got)
        return r if r is not None and not text[r[1] :].strip() else None


def weekday(base: dt.datetime, day: int, n: int = 1) -> dt.datetime:
    """The n-th such day of the week from base on, base itself included; before it for negative n."""
    if n > 0:
        return base + dt.timedelta(days=(day - base.weekday()) % 7 + 7 * (n - 1))
    return base - dt.timedelta(days=(base.weekday() - day) % 7 + 7 * (-n - 1))
