"""Operator 6: personal identifiers and secrets by bootstrapped contextual extraction.

Everything that looks like an identifier (it has a digit, an at sign, or follows a name and a sign of assignment) is an
instance. Those of unmistakable form are seeds, of a kind each; dates, times, versions and plain amounts are counter-
examples. An instance occurs with lexical patterns: its own shape, the one and two words before it, and the words on both
sides. Over the graph of instances and patterns, rounds of scoring give a pattern the share of its instances that are
held to be of one kind, and an instance what its patterns say together, until no pattern changes its kind, or its
confidence by more than SETTLED. Patterns of high confidence then find identifiers that no seed form covers.

A value of any length is taken whole; CONTEXT and LONG bound only what a pattern says of the words around it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import discard, free_name, in_parts, saved

#: What a pattern of each family counts for at full confidence.
WEIGHTS = {"S": 0.9, "L": 0.9, "C": 0.7, "l": 0.5}
#: An instance is an identifier from this score on.
THRESHOLD = 0.85
#: Different seeds that a pattern needs, and the confidence below which it says nothing.
SUPPORT, CONFIDENT = 3, 0.6
#: Rounds end when no confidence moves by more than this, and at the latest after so many.
SETTLED, ROUNDS = 0.001, 20
#: Patterns that go to the executors at once for masking; beyond it, found places are joined to the texts.
MAX_PATTERNS = 50_000
#: What a lexical pattern is made of: the words within so many signs before and after a value, and of each the signs nearest
#: to it. Shapes of more signs keep their first ones and a hash of the whole.
CONTEXT, LONG = 120, 40

_ANCHOR = re.compile(r"[0-9@=:]")
_NAME = r"(?i:\b(?:api[_\-]?key|access[_\-]?key|private[_\-]?key|secret|token|passw(?:or)?d|passwd|pwd|auth[_\-]?token)\w{0,12})\s{0,3}"
_NAMED = re.compile(_NAME + ":$")
_NAME_ENDS, _ASSIGNS = re.compile(_NAME + "$"), re.compile(r"\s{0,3}[:=]")
#: How far a name may stand before its sign of assignment.
_REACH = 72
#: Longer than any form with inner blanks, and what must or must not follow it.
_LONGEST = 700
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CANDIDATE = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]++@[\w\-]++(?:\.[\w\-]++)++)"
    rf"|(?:{_NAME}[:=]\s{{0,3}}[\"']?)(?P<secret>[^\s\"'<>,;]{{6,}}+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    rf"|(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|\+\d{9,14})(?![\w]))"
    r"|(?P<number>(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w]|[.\-]\d))"
    r"|(?P<no>(?<![\w.])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}:\d{2}(?::\d{2})?|[vV]?\d{1,3}(?:\.\d{1,3}){1,3}|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,4})(?![\w]|[.\-/]\d))"
    r"|(?P<other>(?<![^\W_])[^\W_][\w\-./+#]*+)"
)
#: Every form has one of these in its first word.
_START = re.compile(r"\w")
_VALUE = re.compile(r"[^\s\"'<>,;]+")
_DIGIT = re.compile(r"[0-9]")
KINDS = ("email", "secret", "iban", "ip", "ssn", "phone", "number")
_WORD = re.compile(r"\S+")
_BLANK = re.compile(r"\s")


def _short(s: str) -> str:
    return s if len(s) <= LONG else f"{s[:LONG]}~{hashlib.blake2b(s.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def _iban(v: str) -> bool:
    s = v.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def shape(value: str) -> str:
    """Digits as 9, lower-case letters as a, others as A, runs of letters drawn together; the rest stands."""
    s = re.sub(r"\d", "9", value)
    s = re.sub(r"[^\W\d_]+", lambda m: "a" if m[0].islower() else "A", s)
    return _short(re.sub(r"9{20,}", "9+", s))


def _bucket(value: str) -> str:
    """How long a value is, in powers of two."""
    return str(len(value).bit_length())


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, stop, kind, patterns) of every instance; kind is a seed's, "no" for counterexamples, "" for unknown ones.

    The text is read around its anchors only, each place once: from the word of an anchor (or a name that stands before it)
    to that word's end, and on to the end of what starts in between.
    """
    out: list[tuple[int, int, str, list[str]]] = []
    at = done = read = 0  # done: the last instance's end; read: no form but a secret's starts before it
    n = len(text)
    while True:
        m = _ANCHOR.search(text, at)
        if m is None:
            return out
        if m[0] == ":" and not _NAMED.search(text, max(0, m.start() - 40), m.end()):
            at = m.end()
            continue
        lo = max(done, m.start() - _REACH)
        edge = max(done, read)
        while lo > edge and not text[lo - 1].isspace():
            lo -= 1
        end = _BLANK.search(text, m.end())
        hi = end.start() if end else n
        while _START.search(text, lo, hi):
            c = _CANDIDATE.search(text, lo, min(n, hi + _LONGEST))
            if c is None or c.start() >= hi:
                break
            kind = c.lastgroup
            a, b = c.span(kind)
            if c.start() < read and kind != "secret":
                lo = max(lo + 1, min(b, read))
                continue
            lo = b
            if kind == "secret":
                b = lo = _VALUE.match(text, a).end()
            if kind == "other":
                name = _NAME_ENDS.search(text, max(a, b - 40), b)
                if name and name.start() > a and _ASSIGNS.match(text, b):
                    b = lo = name.start()  # what follows has the name before it
                b = a + len(text[a:b].rstrip("./+-#_"))
                if b - a < 5 or not _DIGIT.search(text, a, b):
                    continue
                kind = ""
            elif kind == "secret" and b - a < 20 and not _DIGIT.search(text, a, b):
                continue  # a word in prose
            elif kind == "iban" and not _iban(text[a:b]):
                kind = ""
            done = b
            value = text[a:b]
            left = [w.lower()[-LONG:] for w in _WORD.findall(text, max(0, a - CONTEXT), a)[-2:]]
            right = _WORD.search(text, b, b + CONTEXT)
            size = _bucket(value)
            patterns = ["S|" + shape(value)]
            if left:
                patterns.append(f"l|{left[-1]}|{size}")
                if right:
                    patterns.append(f"C|{left[-1]}|{right[0].lower()[:LONG]}|{size}")
            if len(left) == 2:
                patterns.append(f"L|{left[0]} {left[1]}|{size}")
            out.append((a, b, kind, patterns))
        read = max(read, hi)
        at = max(m.end(), hi, done)


def _instances(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash bigint, start bigint, stop bigint, kind string, value string, patterns array<string>"
    names = ["doc_id", "text_hash", "start", "stop", "kind", "value", "patterns"]
    t = F.col(f"`{text_col}`")
    narrow = docs.where(t.rlike("[0-9@=:]")).select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(x for part in in_parts(b.column(2)) for x in part):
                for a, z, k, p in candidates(text):
                    rows.append(i)
                    found.append((a, z, k, text[a:z], p))
            take = pa.array(rows, pa.int64())
            a, z, k, v, p = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(k, pa.string()), pa.array(v, pa.string()), pa.array(p, pa.list_(pa.string()))], names)

    return narrow.mapInArrow(run, schema)


def _weight() -> F.Column:
    w = F.lit(0.0)
    for family, v in WEIGHTS.items():
        w = F.when(F.col("pattern").startswith(family), F.lit(v)).otherwise(w)
    return w


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, says): patterns of high confidence, the kind that they point to and how strongly.

    A round scores patterns by the instances and then the instances that are neither seeds nor counterexamples by the
    patterns; it ends when the patterns stay as they are (see SETTLED). An instance that is a seed in one place is one
    everywhere. Patterns stand in the shared folder; those of a tie between kinds go to the later kind by name.
    """
    edges = saved(instances.select("value", F.explode("patterns").alias("pattern")).distinct())
    start = instances.groupBy("value").agg(F.max("kind").alias("most"), F.max(F.when(F.col("kind").isin(*KINDS), F.col("kind"))).alias("seed"))
    label = saved(start.select("value", F.coalesce("seed", "most").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"), (F.coalesce("seed", "most") != "").alias("fixed")))
    before = None
    for _ in range(rounds):
        held = edges.join(label, "value")
        of_kind = held.groupBy("pattern", "kind").agg(F.sum("score").alias("yes"), F.sum((F.col("score") > 0).cast("int")).alias("n"), F.count(F.lit(1)).alias("every"))
        of_kind = of_kind.groupBy("pattern").agg(F.max(F.struct("yes", "n", F.when(F.col("kind").isin(*KINDS), F.col("kind")).alias("kind"))).alias("top"), F.sum("every").alias("every"))
        patterns = of_kind.where((F.col("top.n") >= support) & F.col("top.kind").isNotNull()).select("pattern", F.col("top.kind").alias("kind"), (F.col("top.yes") / F.col("every")).alias("confidence"))
        patterns = saved(patterns.where(F.col("confidence") >= confident).select("pattern", "kind", (F.col("confidence") * _weight()).alias("says")))
        if before is not None:
            both = patterns.join(before.select("pattern", F.col("kind").alias("k"), F.col("says").alias("s")), "pattern", "full")
            same = F.col("kind").eqNullSafe(F.col("k")) & (F.abs(F.col("says") - F.col("s")) <= SETTLED)
            settled = both.where(~F.coalesce(same, F.lit(False))).isEmpty()
            discard(before)
            if settled:
                break
        before = patterns
        said = edges.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("says"))))).alias("score"))
        said = said.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("new"))
        accepted = F.coalesce(F.col("new.score"), F.lit(0.0)) >= THRESHOLD
        old = label
        label = saved(label.join(said, "value", "left").select("value", F.when(F.col("fixed"), F.col("kind")).when(accepted, F.col("new.kind")).otherwise("").alias("kind"), F.when(F.col("fixed"), F.col("score")).when(accepted, F.col("new.score")).otherwise(0.0).alias("score"), "fixed"))
        discard(old)
    discard(edges, label)
    return patterns


def judge(kind: str, patterns: list[str], known: dict[str, tuple[str, float]]) -> tuple[str | None, float]:
    """(kind, score) of an instance; kind is null if it isn't an identifier."""
    if kind == "no":
        return None, 0.0
    if kind:
        return kind, 1.0
    by: dict[str, float] = {}
    for p in patterns:
        if p in known:
            k, says = known[p]
            by[k] = by.get(k, 1.0) * (1 - says)
    if not by:
        return None, 0.0
    best = min(by, key=lambda k: (by[k], k))
    score = 1 - by[best]
    return (best, score) if score >= THRESHOLD else (None, score)


def _found(instances: DataFrame, patterns: DataFrame) -> DataFrame:
    """instances held to be identifiers, with kind and score."""
    seeds = instances.where(F.col("kind").isin(*KINDS)).select("doc_id", "text_hash", "start", "stop", "kind", "value", F.lit(1.0).alias("score"))
    rest = instances.where("kind = ''").select("doc_id", "text_hash", "start", "stop", "value", F.explode("patterns").alias("pattern"))
    # a repeated row gives each of its instances twice over, which the grouping draws together: numbered apart first
    key = ["doc_id", "text_hash", "start", "stop", "value"]
    copies = instances.where("kind = ''").groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    said = rest.distinct().join(patterns, "pattern").groupBy(*key, "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("says"))))).alias("score"))
    said = said.groupBy(*key).agg(F.max(F.struct("score", "kind")).alias("top")).where(F.col("top.score") >= THRESHOLD)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    both = said.alias("a").join(copies.alias("b"), same[0] & same[1] & same[2] & same[3] & same[4])
    both = both.select(*(F.col(f"a.{c}") for c in key), F.col("a.top.kind").alias("kind"), F.col("a.top.score").alias("score"), F.explode(F.sequence(F.lit(1), F.col("b.copies"))).alias("copy"))
    return seeds.unionByName(both.select("doc_id", "text_hash", "start", "stop", "kind", "value", "score"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, kind, value, score): every identifier, by character places in the text.

    Null and empty texts hold none; null ids and repeated rows count like others, a repeated row's identifiers come
    once for each row; of equal scores the later kind by name is taken; other columns are not read; an empty table gives
    no rows; long texts are read whole.
    """
    instances = saved(_instances(docs, id_col, text_col))
    return _found(instances, bootstrap(instances)).drop("text_hash")


def _masked(text: str, places: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(places):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs' rows and columns, every identifier in the text replaced by its kind's name in angle brackets.

    Null texts stay null, empty ones empty; null ids and repeated rows are masked like others, a row each; texts are read
    whole; of instances that could be of two kinds the later by name is taken; docs' columns may have any names; an empty
    table gives no rows. Up to max_patterns patterns go to the executors and the texts don't move; of more than that, the
    places found are joined to the texts by the texts' hashes. Both ways give the same.
    """
    instances = saved(_instances(docs, id_col, text_col))
    patterns = bootstrap(instances)
    t = F.col(f"`{text_col}`")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if patterns.count() <= max_patterns:
        known = {r["pattern"]: (r["kind"], r["says"]) for r in patterns.collect()}

        @F.arrow_udf("string")
        def masked(c: pa.Array) -> pa.Array:
            out = []
            for text in (x for part in in_parts(c) for x in part):
                if text is not None:
                    got = [(a, b, judge(k, p, known)[0]) for a, b, k, p in candidates(text)]
                    text = _masked(text, [x for x in got if x[2]])
                out.append(text)
            return pa.array(out, pa.string())

        made = F.when(t.rlike("[0-9@=:]"), masked(t)).otherwise(t)
        return docs.select(*(made.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))

    h, places = free_name(docs, "text_hash"), free_name(docs, "places")
    found = _found(instances, patterns).groupBy(F.col("text_hash").alias(h)).agg(F.collect_set(F.struct("start", "stop", "kind")).alias(places))

    @F.arrow_udf("string")
    def replaced(c: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array([x if x is None or not y else _masked(x, [(q["start"], q["stop"], q["kind"]) for q in y]) for x, y in zip(c.to_pylist(), p.to_pylist())], pa.string())

    with_hash = docs.select(*columns, F.xxhash64(t).alias(h)).join(found, h, "left")
    return with_hash.select(*(replaced(t, F.col(places)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
