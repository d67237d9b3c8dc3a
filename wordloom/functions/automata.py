"""Finite automata over strings: built by hand, from globs, simple regular expressions, word lists and edit distances.

They serve to walk a sorted lexicon (find_all_matches) and, as a predicate on the distinct terms of a corpus, to expand a
query (term_predicate): Arrow batches of terms, each seen once.
"""

from __future__ import annotations

import bisect
import enum
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F



class Label(enum.Enum):
    """Labels beside single characters: any character, and a step that reads none."""

    ANY = 1
    EPSILON = 2


ANY, EPSILON = Label.ANY, Label.EPSILON


class DFA:
    """Transitions by state and character, a default by state for all other characters, and final states."""

    def __init__(self, start: Hashable):
        self.start = start
        self.steps: dict[Hashable, dict[str, Hashable]] = {}
        self.default: dict[Hashable, Hashable] = {}
        self.final: set[Hashable] = set()

    def add(self, src: Hashable, label: object, to: Hashable) -> None:
        if label is ANY:
            self.default[src] = to
        else:
            self.steps.setdefault(src, {})[label] = to

    def next(self, state: Hashable, c: str) -> Hashable | None:
        return self.steps.get(state, {}).get(c, self.default.get(state))

    def accepts(self, s: str) -> bool:
        state = self.start
        for c in s:
            state = self.next(state, c)
            if state is None:
                return False
        return state in self.final

    def states(self) -> list[Hashable]:
        seen, todo = {self.start: None}, [self.start]
        while todo:
            s = todo.pop()
            for to in (*self.steps.get(s, {}).values(), *([self.default[s]] if s in self.default else [])):
                if to not in seen:
                    seen[to] = None
                    todo.append(to)
        return list(seen)

    def _least_from(self, state: Hashable, longest: int = 1000) -> str | None:
        """The smallest string that leads from a state to a final one, preferring short paths of small characters."""
        level, seen = [(state, "")], {state}
        for _ in range(longest):
            for s, text in level:
                if s in self.final:
                    return text
            new = []
            for s, text in level:
                moves = sorted(self.steps.get(s, {}).items())
                if s in self.default:
                    taken = set(self.steps.get(s, {}))
                    moves.append((next(c for c in map(chr, range(1, 0x110000)) if c not in taken), self.default[s]))
                for c, to in sorted(moves):
                    if to not in seen:
                        seen.add(to)
                        new.append((to, text + c))
            level = new
        return None

    def alive(self) -> set[Hashable]:
        """States from which a final one is reached."""
        back: dict[Hashable, set[Hashable]] = {}
        for s in self.states():
            for to in (*self.steps.get(s, {}).values(), *([self.default[s]] if s in self.default else [])):
                back.setdefault(to, set()).add(s)
        seen, todo = set(self.final), list(self.final)
        while todo:
            for s in back.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def minimized(self) -> DFA:
        """The same language with states told apart only where some string tells them apart."""
        states, alphabet = self.states(), sorted({c for m in self.steps.values() for c in m})
        group = {s: int(s in self.final) for s in states}
        while True:
            key = {s: (group[s], tuple(group.get(self.next(s, c)) for c in alphabet), group.get(self.default.get(s))) for s in states}
            names = {k: i for i, k in enumerate(dict.fromkeys(key[s] for s in states))}
            new = {s: names[key[s]] for s in states}
            if len(set(new.values())) == len(set(group.values())):
                break
            group = new
        out = DFA(group[self.start])
        for s in states:
            for c, to in self.steps.get(s, {}).items():
                out.add(group[s], c, group[to])
            if s in self.default:
                out.add(group[s], ANY, group[self.default[s]])
        out.final = {group[s] for s in states if s in self.final}
        return out


class But:
    """The label of all characters but some."""

    def __init__(self, chars: str):
        self.chars = frozenset(chars)


class NFA:
    """Several states at once; steps by a character, ANY, But(characters) or EPSILON."""

    def __init__(self, start: Hashable):
        self.start = start
        self.steps: dict[Hashable, dict[object, set[Hashable]]] = {}
        self.final: set[Hashable] = set()

    def add(self, src: Hashable, label: object, to: Hashable) -> None:
        self.steps.setdefault(src, {}).setdefault(label, set()).add(to)

    def closure(self, states: Iterable[Hashable]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.steps.get(todo.pop(), {}).get(EPSILON, ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def moved(self, states: frozenset, c: object) -> frozenset:
        out: set[Hashable] = set()
        for s in states:
            for label, to in self.steps.get(s, {}).items():
                if label is ANY or label == c or isinstance(label, But) and c not in label.chars:
                    out |= to
        return self.closure(out)

    def accepts(self, s: str) -> bool:
        states = self.closure([self.start])
        for c in s:
            states = self.moved(states, c)
        return bool(states & self.final)

    def to_dfa(self) -> DFA:
        """By sets of states."""
        start = self.closure([self.start])
        out, todo, seen = DFA(start), [start], {start}
        while todo:
            states = todo.pop()
            if states & self.final:
                out.final.add(states)
            labels: set[object] = set()
            for x in (x for s in states for x in self.steps.get(s, {}) if x is not EPSILON):
                labels |= {ANY, *x.chars} if isinstance(x, But) else {x}
            for x in labels:
                to = self.moved(states, x)
                out.add(states, x, to)
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return out


def product(a: DFA, b: DFA, holds: Callable[[bool, bool], bool]) -> DFA:
    """The automaton of strings for which holds(in a, in b)."""
    out = DFA((a.start, b.start))
    todo, seen = [out.start], {out.start}
    while todo:
        x, y = state = todo.pop()
        if holds(x in a.final, y in b.final):
            out.final.add(state)
        labels = {*a.steps.get(x, {}), *b.steps.get(y, {})}
        for label in (*labels, ANY):
            to = (a.default.get(x), b.default.get(y)) if label is ANY else (a.next(x, label), b.next(y, label))
            if to == (None, None):
                continue
            out.add(state, label, to)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return out


def intersection(a: DFA, b: DFA) -> DFA:
    return product(a, b, lambda x, y: x and y)


def union(a: DFA, b: DFA) -> DFA:
    return product(a, b, lambda x, y: x or y)


def difference(a: DFA, b: DFA) -> DFA:
    return product(a, b, lambda x, y: x and not y)


def strings_dfa(strings: Iterable[str]) -> DFA:
    """The automaton of a word list."""
    out, names = DFA(""), {""}
    for s in strings:
        for i in range(len(s)):
            if s[: i + 1] not in names:
                names.add(s[: i + 1])
                out.add(s[:i], s[i], s[: i + 1])
        out.final.add(s)
    return out


def levenshtein_automaton(term: str, k: int, prefix: int = 0) -> NFA:
    """Strings within k insertions, deletions and substitutions of a term that keep its first letters."""
    out = NFA((0, 0))
    for i in range(len(term) + 1):
        for e in range(k + 1):
            if i < len(term):
                out.add((i, e), term[i], (i + 1, e))
            if e < k and i >= prefix:
                out.add((i, e), ANY, (i, e + 1))
                if i < len(term):
                    out.add((i, e), ANY, (i + 1, e + 1))
                    out.add((i, e), EPSILON, (i + 1, e + 1))
            if i == len(term):
                out.final.add((i, e))
    return out


def glob_automaton(pattern: str) -> NFA:
    """* any characters, ? one, [abc] and [!abc] one of some or none of them, a backslash before a sign for itself."""
    b, i, parts = RegexBuilder(), 0, []
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            parts.append(b.star(b.any()))
        elif c == "?":
            parts.append(b.any())
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end]
            parts.append(b.but(inner[1:]) if inner[0] == "!" else b.charset(inner))
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            parts.append(b.char(pattern[i]))
        else:
            parts.append(b.char(c))
        i += 1
    return b.finish(b.concat(*parts))


class RegexBuilder:
    """Pieces of an automaton, each (first state, last state), put together to a regular expression."""

    def __init__(self) -> None:
        self.nfa = NFA(-1)
        self.count = 0

    def _new(self) -> int:
        self.count += 1
        return self.count

    def _one(self, *labels: object) -> tuple[int, int]:
        a, z = self._new(), self._new()
        for x in labels:
            self.nfa.add(a, x, z)
        return a, z

    def epsilon(self) -> tuple[int, int]:
        return self._one(EPSILON)

    def char(self, c: str) -> tuple[int, int]:
        return self._one(c)

    def any(self) -> tuple[int, int]:
        return self._one(ANY)

    def charset(self, chars: str) -> tuple[int, int]:
        return self._one(*chars)

    def but(self, chars: str) -> tuple[int, int]:
        return self._one(But(chars))

    def concat(self, *parts: tuple[int, int]) -> tuple[int, int]:
        if not parts:
            return self.epsilon()
        for (_, z), (a, _) in zip(parts, parts[1:]):
            self.nfa.add(z, EPSILON, a)
        return parts[0][0], parts[-1][1]

    def choice(self, *parts: tuple[int, int]) -> tuple[int, int]:
        a, z = self._new(), self._new()
        for p, q in parts:
            self.nfa.add(a, EPSILON, p)
            self.nfa.add(q, EPSILON, z)
        return a, z

    def optional(self, part: tuple[int, int]) -> tuple[int, int]:
        self.nfa.add(part[0], EPSILON, part[1])
        return part

    def plus(self, part: tuple[int, int]) -> tuple[int, int]:
        a, z = self._new(), self._new()
        self.nfa.add(a, EPSILON, part[0])
        self.nfa.add(part[1], EPSILON, part[0])
        self.nfa.add(part[1], EPSILON, z)
        return a, z

    def star(self, part: tuple[int, int]) -> tuple[int, int]:
        return self.optional(self.plus(part))

    def finish(self, part: tuple[int, int]) -> NFA:
        self.nfa.start, self.nfa.final = part[0], {part[1]}
        return self.nfa


def regex_limit(pattern: str) -> tuple[str, str | None]:
    """(least, bound): every match of the expression is at least the one and below the other; None: no bound. From the plain
    characters that it begins with."""
    head = ""
    for i, c in enumerate(pattern):
        if c in ".^$*+?{}[]\\|()" or pattern[i + 1 : i + 2] in tuple("*?{"):
            break
        head += c
    if "|" in pattern or not head:
        return "", None
    return head, head[:-1] + chr(ord(head[-1]) + 1)


def find_all_matches(dfa: DFA, lexicon: list[str]) -> Iterator[str]:
    """The strings of a sorted list that the automaton accepts; whole ranges without a way to a final state are leapt over."""
    alive = dfa.alive()
    at = 0
    while at < len(lexicon):
        s, state, dead = lexicon[at], dfa.start, None
        for i, c in enumerate(s):
            state = dfa.next(state, c)
            if state is None or state not in alive:
                dead = s[: i + 1]
                break
        if dead is None:
            if state in dfa.final:
                yield s
            at += 1
        else:
            at = bisect.bisect_left(lexicon, dead[:-1] + chr(ord(dead[-1]) + 1), at + 1) if ord(dead[-1]) < 0x10FFFF else at + 1


def term_predicate(automaton: DFA | NFA) -> Callable[[Column], Column]:
    """A predicate on a column of terms."""

    @F.arrow_udf("boolean")
    def accepted(t: pa.Array) -> pa.Array:
        d = t.dictionary_encode()
        own = [x is not None and automaton.accepts(x) for x in d.dictionary.to_pylist()]
        return pa.array([False if i is None else own[i] for i in d.indices.to_pylist()])

    return lambda c: accepted(c)
