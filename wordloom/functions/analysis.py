"""Analyzers as Column expressions: text to array<struct<t string, pos int, b double>>.

An analyzer is a tokenizer and filters joined by `|`. All steps but those that need a Python function (stems, phonetic
codes, parts of words) are built-in higher-order functions, so that they stay in generated code beside the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of letters, digits and underscores, dots allowed inside; the same in Java's, RE2's and Python's dialect.
WORD = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"
STOP_WORDS = frozenset("a an as at be by if in is it of on or to us we and are can for may not tbd the yet you from have that this when will with your".split())
TOKEN = T.StructType([T.StructField("t", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("b", T.DoubleType())])


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value worked out once: what a lambda refers to is otherwise worked out for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _token(t: Column, pos: Column, b: Column | None = None) -> Column:
    return F.struct(t.cast("string").alias("t"), pos.cast("int").alias("pos"), (F.lit(1.0) if b is None else b).cast("double").alias("b"))


def _numbered(strings: Column) -> Column:
    return F.transform(strings, lambda x, i: _token(x, i))


def _texts(tokens: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(tokens, lambda x: _token(fn(x["t"]), x["pos"], x["b"]))


class Step:
    """One part of an analyzer; `a | b` joins parts."""

    def __or__(self, other: Step) -> Analyzer:
        return Analyzer([*self.parts(), *other.parts()])

    def parts(self) -> list[Step]:
        return [self]

    #: A Python step's input has to be found again in the plan, which a lambda within a lambda prevents.
    python = False

    def apply(self, tokens: Column, mode: str) -> Column:
        raise NotImplementedError

    def on_strings(self, strings: Column) -> Column | None:
        """The step on an array of strings, where it needs neither positions nor boosts; None if there is no such form."""
        return None


class Tokenizer(Step):
    def split(self, text: Column) -> Column:
        """array<string> of the text."""
        raise NotImplementedError

    def apply(self, tokens: Column, mode: str) -> Column:
        return _numbered(self.split(tokens))


class Analyzer(Step):
    def __init__(self, steps: list[Step]):
        self.steps = steps

    def parts(self) -> list[Step]:
        return self.steps

    def tokens(self, text: Column, mode: str = "index") -> Column:
        """array<struct<t, pos, b>>; a null text has none. mode: "index" or "query"."""
        out, steps = self._lowered(F.coalesce(text.cast("string"), F.lit("")))
        for k, s in enumerate(steps):
            if isinstance(s, StopFilter) and any(x.python for x in steps[k + 1 :]):
                out = s.apply_flat(out)
            else:
                out = s.apply(out, mode)
        return F.when(text.isNull(), F.array().cast(T.ArrayType(TOKEN))).otherwise(out)

    def _lowered(self, text: Column) -> tuple[Column, list[Step]]:
        """The text in lower case ahead of the steps where that gives the same words: one call instead of one a word."""
        if len(self.steps) > 1 and isinstance(self.steps[0], RegexTokenizer) and self.steps[0].expression == WORD and isinstance(self.steps[1], LowercaseFilter):
            return F.lower(text), [self.steps[0], *self.steps[2:]]
        return text, self.steps

    def strings(self, text: Column) -> Column | None:
        """array<string> of the terms in index mode, without positions; None where a step needs more than strings."""
        out, steps = self._lowered(F.coalesce(text.cast("string"), F.lit("")))
        if type(steps[0]).apply is not Tokenizer.apply:
            return None
        out = steps[0].split(out)
        for s in steps[1:]:
            out = s.on_strings(out)
            if out is None:
                return None
        return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(out)

    def numbered(self, text: Column) -> Column | None:
        """struct<x array<string>, first int> of the terms in index mode where their places run on from the first's; None
        where they don't, or a step needs more than strings."""
        out, steps = self._lowered(F.coalesce(text.cast("string"), F.lit("")))
        stops = [s for s in steps[1:] if isinstance(s, StopFilter)]
        if self.strings(text) is None or any(isinstance(s, ShingleFilter) for s in steps) or len(stops) > 1 or any(s is not steps[-1] or not s.renumber for s in stops):
            return None
        out = steps[0].split(out)
        for s in steps[1:]:
            out = out if s in stops else s.on_strings(out)
        made = lambda x, first: F.struct(x.alias("x"), F.coalesce(first.cast("int"), F.lit(0)).alias("first"))
        if not stops:
            return made(F.when(text.isNull(), F.array().cast("array<string>")).otherwise(out), F.lit(0))
        # what a stop filter keeps goes by the text: where the first kept text stands first, it is kept
        placed = let(out, lambda every: let(stops[0].on_strings(every), lambda kept: made(kept, F.array_position(every, F.get(kept, F.lit(0))) - 1)))
        return F.when(text.isNull(), made(F.array().cast("array<string>"), F.lit(0))).otherwise(placed)

    def plain(self) -> tuple[tuple | None] | None:
        """(stop,) where the terms are the lower-case words of the text, for functions.words: stop is None, or what the last
        step, a stop filter that renumbers, drops; None where they are anything else."""
        _, steps = self._lowered(F.lit(""))
        if steps is self.steps or not (len(steps) == 1 or len(steps) == 2 and type(steps[1]) is StopFilter and steps[1].renumber):
            return None
        gaps = type(steps[0]) is not RegexTokenizer or steps[0].gaps
        return None if gaps else ((steps[1].stoplist, steps[1].minsize, steps[1].maxsize) if len(steps) == 2 else None,)

    def size(self, text: Column) -> Column:
        """How many terms tokens() gives."""
        s = self.strings(text)
        return F.size(self.tokens(text) if s is None else s)

    def terms(self, text: Column, mode: str = "index") -> Column:
        return F.transform(self.tokens(text, mode), lambda x: x["t"])

    def analyze(self, spark, text: str, mode: str = "query") -> list[str]:
        """The terms of one string, on the driver's session."""
        return spark.range(1).select(self.terms(F.lit(text), mode).alias("x")).first()[0]


class IDTokenizer(Tokenizer):
    def split(self, text: Column) -> Column:
        return F.array(text)


class RegexTokenizer(Tokenizer):
    """What matches, or with gaps what stands between matches."""

    def __init__(self, expression: str = WORD, gaps: bool = False):
        self.expression, self.gaps = expression, gaps

    def split(self, text: Column) -> Column:
        if self.gaps:
            return F.filter(F.split(text, self.expression), lambda x: x != "")
        return F.regexp_extract_all(text, F.lit(self.expression), 0)


class SpaceSeparatedTokenizer(RegexTokenizer):
    def __init__(self) -> None:
        super().__init__(r"[^ \t\r\n]+")


class CommaSeparatedTokenizer(Tokenizer):
    def split(self, text: Column) -> Column:
        return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


class CharsetTokenizer(Tokenizer):
    """Characters through a map; those that it lacks separate tokens."""

    def __init__(self, charmap: dict[str, str]):
        self.charmap = charmap

    def split(self, text: Column) -> Column:
        keep = {k: v for k, v in self.charmap.items() if v}
        known = "".join("\\" + c if c in "\\]^-[&" else c for c in keep)
        single = {k: v for k, v in keep.items() if len(v) == 1}
        out = F.regexp_replace(text, f"[^{known}]+" if known else r".+", " ")
        out = F.translate(out, "".join(single), "".join(single.values()))
        for k, v in keep.items():
            if len(v) > 1:
                out = F.replace(out, F.lit(k), F.lit(v))
        return F.filter(F.split(out, " "), lambda x: x != "")


class PathTokenizer(Tokenizer):
    """/a/b/c gives /a, /a/b and /a/b/c."""

    def split(self, text: Column) -> Column:
        root = F.when(text.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        paths = lambda parts: F.transform(parts, lambda x, i: F.concat(root, F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
        return let(F.filter(F.split(text, "/"), lambda x: x != ""), paths)


class NgramTokenizer(Tokenizer):
    """Character n-grams of the whole value; in query mode of the largest size only."""

    def __init__(self, minsize: int, maxsize: int | None = None):
        self.minsize, self.maxsize = minsize, maxsize or minsize

    def apply(self, tokens: Column, mode: str) -> Column:
        return let(tokens, lambda t: self._grams(t, mode))

    def _grams(self, tokens: Column, mode: str) -> Column:
        sizes = range(self.minsize, self.maxsize + 1) if mode == "index" else [self.maxsize]
        grams = [_windows(tokens, F.lit(n), lambda g, i: _token(g, i - 1)) for n in sizes]
        grams = [F.when(F.length(tokens) >= n, g).otherwise(F.array().cast(T.ArrayType(TOKEN))) for n, g in zip(sizes, grams)]
        return F.array_sort(F.concat(*grams), lambda a, b: F.when(a["pos"] != b["pos"], a["pos"] - b["pos"]).otherwise(F.length(a["t"]) - F.length(b["t"])))


def _windows(t: Column, n: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(substring of n characters, where it starts) all along t."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: made(F.substring(t, i, n), i))


class PassFilter(Step):
    def apply(self, tokens: Column, mode: str) -> Column:
        return tokens


class LowercaseFilter(Step):
    def on_strings(self, strings: Column) -> Column | None:
        return F.transform(strings, lambda t: F.lower(t))

    def apply(self, tokens: Column, mode: str) -> Column:
        return _texts(tokens, lambda t: F.lower(t))


class StripFilter(Step):
    def apply(self, tokens: Column, mode: str) -> Column:
        return _texts(tokens, lambda t: F.trim(t))


class ReverseTextFilter(Step):
    def apply(self, tokens: Column, mode: str) -> Column:
        return _texts(tokens, lambda t: F.reverse(t))


class CharsetFilter(Step):
    """Single characters through a map, such as accents folded."""

    def __init__(self, charmap: dict[str, str]):
        self.single = {k: v for k, v in charmap.items() if len(v) <= 1}
        self.many = {k: v for k, v in charmap.items() if len(v) > 1}

    def apply(self, tokens: Column, mode: str) -> Column:
        def fold(t: Column) -> Column:
            for k, v in self.many.items():
                t = F.replace(t, F.lit(k), F.lit(v))
            kept = sorted(self.single, key=lambda k: self.single[k] == "")
            return F.translate(t, "".join(kept), "".join(self.single[k] for k in kept))

        return _texts(tokens, fold)


class SubstitutionFilter(Step):
    def __init__(self, pattern: str, replacement: str):
        self.pattern, self.replacement = pattern, replacement

    def apply(self, tokens: Column, mode: str) -> Column:
        return _texts(tokens, lambda t: F.regexp_replace(t, self.pattern, self.replacement))


class StopFilter(Step):
    """Drops words of a list and words of other sizes; with renumber the rest stand one after the other from where the first stood."""

    def __init__(self, stoplist: Iterable[str] = STOP_WORDS, minsize: int = 2, maxsize: int | None = None, renumber: bool = True):
        self.stoplist, self.minsize, self.maxsize, self.renumber = sorted(stoplist or ()), minsize, maxsize, renumber

    def apply(self, tokens: Column, mode: str) -> Column:
        kept = F.filter(tokens, lambda x: self._ok(x["t"]))
        if not self.renumber:
            return kept
        return let(kept, lambda k: F.transform(k, lambda x, i: _token(x["t"], F.get(k, F.lit(0))["pos"] + i, x["b"])))

    def _ok(self, t: Column) -> Column:
        c = F.length(t) >= self.minsize
        if self.maxsize is not None:
            c &= F.length(t) <= self.maxsize
        return c & ~t.isin(self.stoplist) if self.stoplist else c

    def on_strings(self, strings: Column) -> Column | None:
        return F.filter(strings, self._ok)

    def apply_flat(self, tokens: Column) -> Column:
        """The same without a lambda within a lambda, for Python steps that follow."""
        kept = F.filter(tokens, lambda x: self._ok(x["t"]))
        if not self.renumber:
            return kept
        first = F.get(kept, F.lit(0))["pos"]
        numbers = F.when(F.size(kept) > 0, F.sequence(first, first + F.size(kept) - 1)).otherwise(F.array().cast("array<int>"))
        return F.zip_with(kept, numbers, lambda x, p: _token(x["t"], p, x["b"]))


class DelimitedAttributeFilter(Step):
    """word^2: the text before the sign, the number after it as boost."""

    def __init__(self, delimiter: str = "^", default: float = 1.0):
        self.delimiter, self.default = delimiter, default

    def apply(self, tokens: Column, mode: str) -> Column:
        def part(x: Column) -> Column:
            head = F.substring_index(x["t"], self.delimiter, 1)
            tail = F.substring_index(x["t"], self.delimiter, -1)
            has = F.contains(x["t"], F.lit(self.delimiter))
            return _token(F.when(has, head).otherwise(x["t"]), x["pos"], F.when(has, F.coalesce(tail.try_cast("double"), F.lit(self.default))).otherwise(F.lit(self.default)))

        return F.transform(tokens, part)


class ShingleFilter(Step):
    """size neighbouring tokens joined; fewer give one shingle of all."""

    def __init__(self, size: int = 2, sep: str = "-"):
        self.size, self.sep = size, sep

    def apply(self, tokens: Column, mode: str) -> Column:
        return let(tokens, self._joined)

    def on_strings(self, strings: Column) -> Column | None:
        return let(strings, self._of_strings)

    def _of_strings(self, x: Column) -> Column:
        starts = F.slice(x, F.lit(1), F.greatest(F.size(x) - self.size + 1, F.lit(0)))
        return F.transform(starts, lambda t, i: F.concat_ws(self.sep, t, *(F.get(x, i + k) for k in range(1, self.size))))

    def _joined(self, tokens: Column) -> Column:
        return let(F.transform(tokens, lambda x: x["t"]), lambda text: self._of(tokens, text))

    def _of(self, tokens: Column, text: Column) -> Column:
        n = F.size(tokens)
        many = F.transform(F.slice(tokens, F.lit(1), F.greatest(n - self.size + 1, F.lit(0))), lambda x, i: _token(F.array_join(F.slice(text, i + 1, F.lit(self.size)), self.sep), x["pos"], x["b"]))
        return F.when(n >= self.size, many).otherwise(F.array().cast(T.ArrayType(TOKEN)))


class BiWordFilter(ShingleFilter):
    """Neighbouring pairs joined; a single token stands."""

    def __init__(self, sep: str = "-"):
        super().__init__(2, sep)

    def apply(self, tokens: Column, mode: str) -> Column:
        return let(tokens, lambda t: F.when(F.size(t) < 2, t).otherwise(self._joined(t)))

    def on_strings(self, strings: Column) -> Column | None:
        return let(strings, lambda x: F.when(F.size(x) < 2, x).otherwise(self._of_strings(x)))


class NgramFilter(Step):
    """Character n-grams of each token, at its start, its end or all over; in query mode of the largest size that fits."""

    def __init__(self, minsize: int, maxsize: int | None = None, at: str | None = None):
        self.minsize, self.maxsize, self.at = minsize, maxsize or minsize, at

    def apply(self, tokens: Column, mode: str) -> Column:
        none = F.array().cast(T.ArrayType(TOKEN))

        def grams(x: Column) -> Column:
            t, size = x["t"], F.length(x["t"])
            if mode == "query":
                n = F.least(F.lit(self.maxsize), size)
                if self.at == "start":
                    out = F.array(_token(F.substring(t, F.lit(1), n), x["pos"], x["b"]))
                elif self.at == "end":
                    out = F.array(_token(F.substring(t, size - n + 1, n), x["pos"], x["b"]))
                else:
                    out = _windows(t, n, lambda g, i: _token(g, x["pos"], x["b"]))
                return F.when(size >= self.minsize, out).otherwise(none)
            parts = []
            for n in range(self.minsize, self.maxsize + 1):
                if self.at == "start":
                    g = F.array(_token(F.substring(t, F.lit(1), F.lit(n)), x["pos"], x["b"]))
                elif self.at == "end":
                    g = F.array(_token(F.substring(t, size - n + 1, F.lit(n)), x["pos"], x["b"]))
                else:
                    g = _windows(t, F.lit(n), lambda g, i: _token(g, x["pos"], x["b"]))
                parts.append(F.when(size >= n, g).otherwise(none))
            return F.concat(*parts)

        return F.flatten(F.transform(tokens, grams))


class CompoundWordFilter(Step):
    """Tokens that are made of two or three words of a set are split into them; the whole stays with keep_compound."""

    python = True

    def __init__(self, wordset: Iterable[str], keep_compound: bool = True):
        self.words, self.keep = frozenset(wordset), keep_compound

    def apply(self, tokens: Column, mode: str) -> Column:
        words, keep = self.words, self.keep

        def split(t: str) -> list[str]:
            best: list[list[str] | None] = [[]] + [None] * len(t)
            for j in range(1, len(t) + 1):
                for i in range(j):
                    if best[i] is not None and t[i:j] in words and (best[j] is None or len(best[i]) + 1 < len(best[j])):
                        best[j] = [*best[i], t[i:j]]
            parts = best[-1]
            if not parts or len(parts) < 2:
                return [t]
            return [t, *parts] if keep else parts

        return _python(tokens, lambda ts: [(s, p, b) for t, p, b in ts for s in split(t)])


def _python(tokens: Column, fn: Callable[[list[tuple[str, int, float]]], list[tuple[str, int, float]]]) -> Column:
    """tokens through a Python function of token lists, by Arrow batches."""
    kind = pa.list_(pa.struct([("t", pa.string()), ("pos", pa.int32()), ("b", pa.float64())]))

    @F.arrow_udf(T.ArrayType(TOKEN))
    def run(c: pa.Array) -> pa.Array:
        out = [None if row is None else [{"t": t, "pos": p, "b": b} for t, p, b in fn([(x["t"], x["pos"], x["b"]) for x in row])] for row in c.to_pylist()]
        return pa.array(out, kind)

    return run(tokens)


def each_word(words: Column, fn: Callable[[str], str]) -> Column:
    """A column of strings through a Python function, once for each different one of an Arrow batch."""

    @F.arrow_udf("string")
    def run(c: pa.Array) -> pa.Array:
        d = c.dictionary_encode()
        return pa.array([None if t is None else fn(t) for t in d.dictionary.to_pylist()], pa.string()).take(d.indices)

    return run(words)


def stopped(tokens: Column) -> Column:
    """Tokens that a StopFilter would take out, beside those that it leaves: array<struct<t, pos, b, stopped>>."""
    return F.transform(tokens, lambda x: F.struct(x["t"].alias("t"), x["pos"].alias("pos"), x["b"].alias("b"), x["t"].isin(*sorted(STOP_WORDS)).alias("stopped")))


def unstopped(tokens: Column) -> Column:
    """Of stopped()'s tokens those that stay."""
    return F.transform(F.filter(tokens, lambda x: ~x["stopped"]), lambda x: _token(x["t"], x["pos"], x["b"]))


def entoken(terms: Column, boost: float = 1.0) -> Column:
    """Tokens from an array of strings, numbered in order."""
    return F.transform(terms, lambda x, i: _token(x, i, F.lit(boost)))


class LoggingFilter(Step):
    """Passes tokens on and counts them in an accumulator: a way to see how many reach a place of a chain."""

    python = True

    def __init__(self, counter: object):
        self.counter = counter

    def apply(self, tokens: Column, mode: str) -> Column:
        counter = self.counter

        def count(ts: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
            counter.add(len(ts))  # type: ignore[attr-defined]
            return ts

        return _python(tokens, count)


class MapFilter(Step):
    """Each token's text through a Python function, once for each different text of a batch."""

    python = True

    def __init__(self, fn: Callable[[str], str], ignore: Iterable[str] = ()):
        self.fn, self.ignore = fn, frozenset(ignore)

    def apply(self, tokens: Column, mode: str) -> Column:
        fn, ignore = self.fn, self.ignore

        @F.arrow_udf(T.ArrayType(TOKEN))
        def run(c: pa.Array) -> pa.Array:
            flat = c.flatten()
            d = flat.field("t").dictionary_encode()
            made = pa.array([t if t is None or t in ignore else fn(t) for t in d.dictionary.to_pylist()], pa.string())
            rows = pa.StructArray.from_arrays([made.take(d.indices), flat.field("pos"), flat.field("b")], ["t", "pos", "b"])
            return pa.ListArray.from_arrays(pa.array([0, *_ends(c)], pa.int32()), rows)

        return run(tokens)


def _ends(c: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    total, out = 0, []
    for n in pc.fill_null(pc.list_value_length(c), 0).to_pylist():
        total += n
        out.append(total)
    return out


class StemFilter(MapFilter):
    def __init__(self, stemfn: Callable[[str], str] | None = None, lang: str | None = None, ignore: Iterable[str] = ()):
        from wordloom.functions import stemming

        super().__init__(stemfn or (stemming.stemmer_for_language(lang) if lang else stemming.porter), ignore)


class DoubleMetaphoneFilter(Step):
    """Phonetic codes with boosts; with combine beside the word itself."""

    python = True

    def __init__(self, primary_boost: float = 1.0, secondary_boost: float = 0.5, combine: bool = False):
        self.first, self.second, self.combine = primary_boost, secondary_boost, combine

    def apply(self, tokens: Column, mode: str) -> Column:
        first, second, combine = self.first, self.second, self.combine

        def codes(ts: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
            from wordloom.functions.phonetic import double_metaphone

            out = []
            for t, p, b in ts:
                if combine:
                    out.append((t, p, b))
                a, z = double_metaphone(t)
                if a:
                    out.append((a, p, b * first))
                if z and z != a:
                    out.append((z, p, b * second))
            return out

        return _python(tokens, codes)


class IntraWordFilter(Step):
    """Parts of words at changes of case, between letters and digits, and at signs; joined runs too where asked for."""

    python = True

    def __init__(self, splitwords: bool = True, splitnums: bool = True, mergewords: bool = False, mergenums: bool = False):
        self.how = (splitwords, splitnums, mergewords, mergenums)

    def apply(self, tokens: Column, mode: str) -> Column:
        splitwords, splitnums, mergewords, mergenums = self.how

        def parts(ts: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
            import regex

            word = r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{L}+" if splitwords else r"\p{L}+"
            rule = regex.compile(rf"{word}|\p{{N}}+" if splitnums else rf"[\p{{L}}\p{{N}}]+")
            out, shift = [], 0
            for t, p, b in ts:
                t = regex.sub(r"['’]s$", "", t)
                found = rule.findall(t)
                if len(found) < 2:
                    out.append((found[0] if found else t, p + shift, b))
                    continue
                for k, x in enumerate(found):
                    out.append((x, p + shift + k, b))
                for on, digit in ((mergewords, False), (mergenums, True)):
                    run = [x for x in found if x[0].isdigit() == digit]
                    if on and len(run) > 1:
                        out.append(("".join(run), p + shift + len(found) - 1, b))
                shift += len(found) - 1
            return out

        return _python(tokens, parts)


class TeeFilter(Step):
    """Several chains over the same tokens, their results side by side in order of position."""

    def __init__(self, *chains: Step):
        self.chains = chains

    def apply(self, tokens: Column, mode: str) -> Column:
        every = [reduce(lambda c, s: s.apply(c, mode), chain.parts(), tokens) for chain in self.chains]
        return F.array_sort(F.concat(*every), lambda a, b: a["pos"] - b["pos"])


class MultiFilter(Step):
    """A filter for each mode."""

    def __init__(self, index: Step | None = None, query: Step | None = None):
        self.by = {"index": index or PassFilter(), "query": query or PassFilter()}

    def apply(self, tokens: Column, mode: str) -> Column:
        return reduce(lambda c, s: s.apply(c, mode), self.by[mode].parts(), tokens)


def IDAnalyzer(lowercase: bool = False) -> Analyzer:
    return Analyzer([IDTokenizer(), *([LowercaseFilter()] if lowercase else [])])


def KeywordAnalyzer(lowercase: bool = False, commas: bool = False) -> Analyzer:
    return Analyzer([CommaSeparatedTokenizer() if commas else SpaceSeparatedTokenizer(), *([LowercaseFilter()] if lowercase else [])])


def RegexAnalyzer(expression: str = WORD, gaps: bool = False) -> Analyzer:
    return Analyzer([RegexTokenizer(expression, gaps)])


def SimpleAnalyzer(expression: str = WORD, gaps: bool = False) -> Analyzer:
    return RegexTokenizer(expression, gaps) | LowercaseFilter()


def StandardAnalyzer(expression: str = WORD, stoplist: Iterable[str] | None = STOP_WORDS, minsize: int = 2, maxsize: int | None = None, gaps: bool = False) -> Analyzer:
    return SimpleAnalyzer(expression, gaps) | StopFilter(stoplist or (), minsize, maxsize)


def StemmingAnalyzer(expression: str = WORD, stoplist: Iterable[str] | None = STOP_WORDS, minsize: int = 2, maxsize: int | None = None, gaps: bool = False, stemfn: Callable[[str], str] | None = None, ignore: Iterable[str] = ()) -> Analyzer:
    return StandardAnalyzer(expression, stoplist, minsize, maxsize, gaps) | StemFilter(stemfn, ignore=ignore)


def FancyAnalyzer(stoplist: Iterable[str] = STOP_WORDS, minsize: int = 2, maxsize: int | None = None) -> Analyzer:
    return RegexTokenizer(r"\s+", gaps=True) | IntraWordFilter() | LowercaseFilter() | StopFilter(stoplist, minsize, maxsize)


def LanguageAnalyzer(lang: str, expression: str = WORD, gaps: bool = False) -> Analyzer:
    from wordloom.functions import stemming

    out = SimpleAnalyzer(expression, gaps)
    if stemming.has_stopwords(lang):
        out = out | StopFilter(stemming.stopwords_for_language(lang))
    return out | StemFilter(lang=lang) if stemming.has_stemmer(lang) else out


def NgramAnalyzer(minsize: int, maxsize: int | None = None) -> Analyzer:
    return Analyzer([_LowerText(), NgramTokenizer(minsize, maxsize)])


class _LowerText(Step):
    def apply(self, tokens: Column, mode: str) -> Column:
        return F.lower(tokens)


def NgramWordAnalyzer(minsize: int, maxsize: int | None = None, tokenizer: Tokenizer | None = None, at: str | None = None) -> Analyzer:
    return (tokenizer or RegexTokenizer()) | LowercaseFilter() | NgramFilter(minsize, maxsize, at)
