"""Operator 7: benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are strings of words. CGK walks over such a string: at step j it puts out the word it stands on and moves on or
stays by a random bit of (j, word), so that strings at a small edit distance give strings at a small Hamming distance,
whatever was inserted or deleted before. Items are grouped by size; every window of a group's size is embedded, and a
table's key is a few sampled places of the embedding. As many tables are built as edited copies of the items, made at
the largest distance allowed, need to reach the target recall. Windows that share a key with an item are held against
it by edit distance, exactly.

Before that, windows that can't match are set aside without loss: of an item cut into one part more than the edits
allowed, one part at least stands unchanged in every match, so only windows around such parts are embedded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import free_name, in_parts, mix64, narrow, word_batches
from wordloom.llm.toxicity import _among

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
#: Sampled places in a key, and the share of copies at the largest distance that the tables must find.
PLACES, RECALL = 3, 0.97
#: Items, and bytes of their texts, whose tables go to the executors at once; more are done in turns, a pass over the
#: documents each.
ITEMS_A_PASS, BYTES_A_PASS = 50_000, 64_000_000


def allowed(m: int, share: float = EDITS) -> int:
    return int(share * m + 1e-9)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, stop) of the substring of text nearest to item: Sellers' dynamic programming, by columns of text."""
    m = len(item)
    rows = np.arange(m + 1)
    d, s = rows.copy(), np.zeros(m + 1, np.int64)
    best = (m, 0, 0)
    for j, x in enumerate(text, 1):
        sub = d[:-1] + (item != x)
        ins = d[1:] + 1
        step = np.minimum(sub, ins)
        start = np.where(sub <= ins, s[:-1], s[1:])
        low = np.concatenate([[0], step]) - rows
        low_start = np.concatenate([[j], start])
        run = np.minimum.accumulate(low)
        source = np.maximum.accumulate(np.where(low == run, rows, 0))
        d, s = run + rows, low_start[source]
        if d[m] < best[0]:
            best = (int(d[m]), int(s[m]), j)
    return best


@dataclass
class Group:
    """Items of similar size: size is the smallest's, tables hold the items' keys for each repetition."""

    size: int
    items: list[int]
    seeds: list[int]
    places: list[np.ndarray]
    keys: list[tuple[np.ndarray, np.ndarray]]


def keys_of(h: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int, places: np.ndarray, size: int) -> np.ndarray:
    """Keys of the windows h[start:start + size], none beyond stop; places: rising steps of the walk."""
    at = start.copy()
    end = np.minimum(start + size, stop)
    out = np.zeros(len(start), np.uint64)
    bits, block, k = None, -1, 0
    with np.errstate(over="ignore"):
        for j in range(int(places[-1]) + 1):
            inside = at < end
            p = np.minimum(at, len(h) - 1)
            if j == places[k]:
                out = mix64(out ^ np.where(inside, h[p], np.uint64(0)), k)
                k += 1
            if j // 64 != block:
                block = j // 64
                bits = mix64(h, 7919 * seed + block)
            at += ((bits[p] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) & inside
    return out


def _edited(item: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    x = list(item)
    for _ in range(k):
        what, p = r.integers(3), int(r.integers(len(x))) if x else 0
        if what == 0 and x:
            x[p] = np.uint64(r.integers(1 << 62))
        elif what == 1:
            x.insert(p, np.uint64(r.integers(1 << 62)))
        elif x:
            del x[p]
    return np.array(x, np.uint64)


def _draw(seed: int, size: int, places: int) -> np.ndarray:
    """Places of one table, in the part of the walk that stays within the window."""
    r = np.random.default_rng(seed)
    reach = max(places, math.ceil(1.6 * size))
    return np.sort(r.choice(reach, min(places, reach), replace=False))


def repetitions(items: list[np.ndarray], size: int, share: float, places: int, recall: float, first: int, trials: int = 48, copies: int = 120) -> int:
    """Tables that find the given share of edited copies, at the largest distance that items allow."""
    r = np.random.default_rng(size)
    pairs = []
    for n in range(copies):
        x = items[n % len(items)]
        pairs.append((x, _edited(x, allowed(len(x), share), r)))
    flat = np.concatenate([np.concatenate(p) for p in pairs])
    at = np.concatenate([[0], np.cumsum([len(s) for p in pairs for s in p])])
    hit = np.zeros(copies)
    for t in range(trials):
        key = keys_of(flat, at[:-1], at[1:], first + t, _draw(first + t, size, places), size).reshape(-1, 2)
        hit += key[:, 0] == key[:, 1]
    p = (hit + 0.5) / (trials + 1)  # never 0, so that some number of tables reaches any recall below 1
    n = 1
    while (1 - (1 - p) ** n).mean() < recall:
        n += 1
    return n


class Matcher:
    """Tables of the items (identifiers and texts), and the search of texts for them."""

    def __init__(self, ids: list, texts: list[str | None], share: float = EDITS, places: int = PLACES, recall: float = RECALL):
        self.share = share
        self.ids: list = []
        self.words: list[np.ndarray] = []
        for rows, h, at in word_batches(texts):
            for i, r in enumerate(rows):
                self.ids.append(ids[r])
                self.words.append(h[at[i] : at[i + 1]])
        self.most = max(map(len, self.words), default=0)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by.setdefault(int(2 * math.log2(len(w))), []).append(i)
        self.groups: list[Group] = []
        parts: dict[int, dict[int, int]] = {}  # by length: hash of a part -> bits of groups
        for g, (_, items) in enumerate(sorted(by.items())):
            size = min(len(self.words[i]) for i in items)
            own = [self.words[i] for i in items]
            n = repetitions(own, size, share, places, recall, 1000 * g)
            h = np.concatenate(own)
            at = np.concatenate([[0], np.cumsum([len(w) for w in own])])
            seeds = list(range(1000 * g, 1000 * g + n))
            draws = [_draw(s, size, places) for s in seeds]
            keys = []
            for s, p in zip(seeds, draws):
                k = keys_of(h, at[:-1], at[1:], s, p, size)
                order = np.argsort(k, kind="stable")
                keys.append((k[order], np.array(items)[order]))
            self.groups.append(Group(size, items, seeds, draws, keys))
            for w in own:
                e = allowed(len(w), share) + 1
                cuts = np.linspace(0, len(w), e + 1).astype(int)
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        t = parts.setdefault(int(b - a), {})
                        key = int(self._gram(w, b - a)[a])
                        t[key] = t.get(key, 0) | 1 << g
        self.parts = {}
        for q, t in parts.items():
            k = np.array(sorted(t), np.uint64)
            self.parts[q] = (k, [t[int(x)] for x in k])

    @staticmethod
    def _gram(h: np.ndarray, q: int) -> np.ndarray:
        """Hash of h[i : i + q] at each i that has so many."""
        n = len(h) - q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = h[:n].copy()
            for j in range(1, q):
                out *= np.uint64(0x9E3779B97F4A7C15)
                out ^= h[j : j + n]
            out ^= out >> np.uint64(32)
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, edits, first word, words) of every item in it, at its best place, by item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for rows, h, at in word_batches(texts):
            for i, found in self._batch(h, at).items():
                out[rows[i]] = sorted((k, *v) for k, v in found.items())
        return out

    def _batch(self, h: np.ndarray, at: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        hits: dict[int, list[np.ndarray]] = {}
        for q, (table, flags) in self.parts.items():
            g = self._gram(h, q)
            p = np.flatnonzero(_among(g, table))
            if len(p):
                p = p[np.searchsorted(at, p, "right") == np.searchsorted(at, p + q - 1, "right")]
                flag = [flags[k] for k in np.searchsorted(table, g[p]).tolist()]
                for k in range(len(self.groups)):
                    own = [x for x, f in zip(p.tolist(), flag) if f >> k & 1]
                    if own:
                        hits.setdefault(k, []).append(np.array(own))
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        for k, parts in hits.items():
            group = self.groups[k]
            p = np.unique(np.concatenate(parts))
            far = max(len(self.words[i]) for i in group.items)
            far += allowed(far, self.share)
            doc = np.searchsorted(at, p, "right") - 1
            # windows that may hold such a part, each once
            mark = np.zeros(len(h) + 1, np.int32)
            np.add.at(mark, np.maximum(p - far, at[doc]), 1)
            np.add.at(mark, np.minimum(p + 1, at[doc + 1]), -1)
            start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            doc = np.searchsorted(at, start, "right") - 1
            # only the words that these windows can reach take part in the walk
            reach = np.zeros(len(h) + 1, np.int32)
            np.add.at(reach, start, 1)
            np.add.at(reach, np.minimum(start + group.size + 1, len(h)), -1)
            used = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
            place = np.zeros(len(h) + 1, np.int64)
            place[used] = np.arange(len(used))
            sub, local = h[used], place[start]
            stop = local + np.minimum(at[doc + 1] - start, group.size)
            pairs: set[tuple[int, int]] = set()
            for seed, places, (keys, items) in zip(group.seeds, group.places, group.keys):
                key = keys_of(sub, local, stop, seed, places, group.size)
                like = np.flatnonzero(_among(key, keys))
                if len(like):
                    a, b = np.searchsorted(keys, key[like], "left"), np.searchsorted(keys, key[like], "right")
                    for w, i, j in zip(like.tolist(), a.tolist(), b.tolist()):
                        pairs.update((w, int(x)) for x in items[i:j])
            self._verify(h, at, start, doc, pairs, found)
        return found

    def _verify(self, h: np.ndarray, at: np.ndarray, start: np.ndarray, doc: np.ndarray, pairs: set[tuple[int, int]], found: dict) -> None:
        """Windows of one item that lie close together are held against it once, over all words that they cover."""
        by: dict[tuple[int, int], list[int]] = {}
        for w, i in pairs:
            by.setdefault((int(doc[w]), i), []).append(int(start[w]))
        for (d, i), starts in by.items():
            item = self.words[i]
            k = allowed(len(item), self.share)
            lo, hi = int(at[d]), int(at[d + 1])
            inside = np.unique(item)
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(lo, s - k), min(hi, s + len(item) + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                # fewer words in common than a match has: no need for the table
                if np.isin(h[a:b], inside).sum() < len(item) - k:
                    continue
                edits, s, e = best_match(item, h[a:b])
                old = found.get(d, {}).get(i)
                if edits <= k and (old is None or edits < old[0]):
                    found.setdefault(d, {})[i] = (edits, a + s - lo, e - s)


def _matches(matcher: Matcher, id_type: pa.DataType, spark_type: str):
    kind = pa.struct([("item_id", id_type), ("edits", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    @F.arrow_udf(f"array<struct<item_id:{spark_type},edits:int,first_word:bigint,n_words:bigint>>")
    def matches(t: pa.Array) -> pa.Array:
        got = [m for part in in_parts(t) for m in matcher.find(part)]
        return pa.array([[{"item_id": matcher.ids[i], "edits": e, "first_word": s, "n_words": n} for i, e, s, n in m] for m in got], pa.list_(kind))

    return matches


def _passes(benchmark: DataFrame, share: float, places: int, recall: float, item_col: str, text_col: str, items_a_pass: int):
    """A matcher for each turn of items with a text. Equal texts under several identifiers are items each."""
    kind = benchmark.schema[item_col].dataType
    items = narrow(benchmark, item_col, text_col).where(F.col(f"`{text_col}`").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("bytes")).first()
    turns = max(-(-size["n"] // items_a_pass), -(-(size["bytes"] or 0) // BYTES_A_PASS))
    for n in range(turns):
        part = items.where(F.pmod(F.xxhash64(F.col(f"`{item_col}`")), F.lit(turns)) == n).orderBy(item_col, text_col).collect() if turns > 1 else items.orderBy(item_col, text_col).collect()
        from pyspark.sql.pandas.types import to_arrow_type

        yield _matches(Matcher([r[0] for r in part], [r[1] for r in part], share, places, recall), to_arrow_type(kind), kind.simpleString())


def find(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, places: int = PLACES, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words): every item found in every document, at its best place.

    Words are runs of letters and digits in lower case. An item of m words is found where a run of words lies within
    share * m edits of words; of equally good places the first is given. Null and empty texts hold nothing and, as items,
    are in nothing; null identifiers and repeated rows count like others, of documents and of items; long texts are searched
    whole; other columns are not read; an empty table of either kind gives no rows. No shuffle: items go to the executors,
    items_a_pass at a time.
    """
    d = narrow(docs, id_col, text_col).where(F.col(f"`{text_col}`").isNotNull())
    parts = [d.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(m(F.col(f"`{text_col}`"))).alias("m")).select("doc_id", "m.*") for m in _passes(benchmark, share, places, recall, item_col, item_text_col, items_a_pass)]
    if not parts:
        kind = benchmark.schema[item_col].dataType
        none = d.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("edits"), F.lit(0).cast("bigint").alias("first_word"), F.lit(0).cast("bigint").alias("n_words"))
        return none.where("false")
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, places: int = PLACES, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """docs' rows and columns without those that hold an item.

    Rows with a null or empty text stay; repeated rows and null ids stay or go each by its text; an item at the largest
    distance itself counts; long texts are searched whole; docs' columns may have any names; an empty table of documents
    gives no rows, one of items takes none away.
    """
    for m in _passes(benchmark, share, places, recall, item_col, item_text_col, items_a_pass):
        p = free_name(docs, "leaks")
        held: Column = F.coalesce(F.size(F.col(p)), F.lit(0))
        docs = docs.withColumn(p, m(F.col(f"`{text_col}`"))).where(held <= 0).drop(p)
    return docs
