"""Operator 10: near-duplicates by ProbMinHash over weighted word shingles, banding, and exact verification.

Each shingle of weight w (its count) has arrivals of a Poisson process of rate w, each falling into one of SLOTS
slots; a slot keeps its earliest arrival. Two texts' slots agree with the probability Jaccard similarity
J_P(v, w) = sum over common d of 1 / sum over e of max(v_e / v_d, w_e / w_d). A shingle whose next arrival comes after
the latest slot of its text can change nothing more and stops.

Equal texts are one text from the start. In each band's bucket the smallest identifiers lead: others are held against
them, and who matches none goes on to a next round with twice as many leaders, until nobody is left. Then rows of one
bucket that no chain of found pairs connects are held against each other, whether a leader matched them or not, the
first few of each group before the rest; so every two texts that share a bucket are held against each other or are in one
group already, and a bucket of copies costs as many pairs as it has texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import discard, free_name, in_parts, mix64, saved, shared_hashes, shingle_hashes, with_vertex, word_batches

SLOTS, ROWS = 128, 3
BANDS = SLOTS // ROWS
SHINGLE = 3
#: J_P from which two texts are near-duplicates, and how far a sum of shares may be off.
THRESHOLD, EPSILON = 0.5, 1e-9
#: An estimate from SLOTS slots is this far off, at most, in all but one of 30,000 pairs; nearer ones are verified.
MARGIN = 0.18
#: Rows of each unconnected group of a bucket that are held against other groups' at first, and how many times more next.
FIRST = 8
#: Pairs (16 bytes each) or keys of rows (24) that go to all executors, so that signatures and texts that they don't need stay where they are.
FEW = 200_000
#: A band is hot from one in HOT of the ids on; one in SEEN of the ids are looked at to tell.
HOT, SEEN = 10_000, 64


def weighted(h: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of every distinct shingle of every row."""
    row, s = shingle_hashes(h, at, k)
    if not len(s):
        return row, s, np.zeros(0)
    key = s ^ mix64(row.astype(np.uint64), 11)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    return row[order[first]], s[order[first]], count.astype(float)


def signatures(row: np.ndarray, s: np.ndarray, w: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """uint32 (n, slots): of each slot's earliest arrival, its shingle. All shingles of all rows advance together."""
    q = np.full(n * slots, np.inf)
    got = np.zeros(n * slots, np.uint32)
    x = np.zeros(len(s))
    mask = np.uint64(slots - 1)
    step = 0
    while len(s):
        r = mix64(s, 1000 + step)
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        flat = row * slots + (r & mask).astype(np.int64)
        np.minimum.at(q, flat, x)
        won = x == q[flat]
        got[flat[won]] = (s[won] >> np.uint64(32)).astype(np.uint32)
        last = q.reshape(n, slots).max(axis=1)
        go = x < last[row]
        row, s, w, x = row[go], s[go], w[go], x[go]
        step += 1
    return got.reshape(n, slots)


def sketch(texts: list[str | None], slots: int = SLOTS, k: int = SHINGLE) -> list[bytes | None]:
    out: list[bytes | None] = [None] * len(texts)
    for rows, h, at in word_batches(texts):
        sig = signatures(*weighted(h, at, k), len(rows), slots)
        for i, r in enumerate(rows):
            out[r] = sig[i].tobytes()
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two texts' (sorted shingles, counts), exactly."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    v, w = np.zeros(len(every)), np.zeros(len(every))
    v[np.searchsorted(every, a[0])] = a[1]
    w[np.searchsorted(every, b[0])] = b[1]
    both = (v > 0) & (w > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(w > 0, v / np.where(w > 0, w, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    rs = ratio[order]
    vs, ws = np.concatenate([[0], np.cumsum(v[order])]), np.concatenate([[0], np.cumsum(w[order])])
    upto = np.searchsorted(rs, ratio[both], "right")
    return float((1 / ((vs[-1] - vs[upto]) / v[both] + ws[upto] / w[both])).sum())


def _shingle_sets(texts: list[str | None], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    none = (np.zeros(0, np.uint64), np.zeros(0))
    out = [none] * len(texts)
    for rows, h, at in word_batches(texts):
        row, s, w = weighted(h, at, k)
        order = np.lexsort((s, row))
        row, s, w = row[order], s[order], w[order]
        edge = np.searchsorted(row, np.arange(len(rows) + 1))
        for i, r in enumerate(rows):
            out[r] = (s[edge[i] : edge[i + 1]], w[edge[i] : edge[i + 1]])
    return out


def _verifier(k: int):
    @F.arrow_udf("double")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        # a text that many pairs share is read once a batch
        def sets(c: pa.Array) -> list:
            d = c.dictionary_encode()
            own = _shingle_sets(d.dictionary.to_pylist(), k)
            return [own[i] for i in d.indices.to_pylist()]

        return pa.array([probability_jaccard(x, y) for x, y in zip(sets(a), sets(b))], pa.float64())

    return exact


@F.arrow_udf(T.BinaryType())
def _short(sig: pa.Array) -> pa.Array:
    """A byte of each slot. Equal slots have equal bytes, so no pair agrees in fewer of them than in its slots; of other
    slots one in 256 does, and what that lets through is verified like the rest."""
    low = np.ascontiguousarray(np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(sig), -1)[:, ::4])
    return pa.array([x.tobytes() for x in low], pa.binary())


@F.arrow_udf(T.DoubleType())
def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(len(b), -1)
    return pa.array((x == y).mean(axis=1))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, h1, h2) of rows with an id and a text."""
    t = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(7)).alias("h2")).where("doc_id is not null and text is not null")


def _sketches(docs: DataFrame, id_col: str, text_col: str, slots: int, k: int) -> DataFrame:
    """(doc_id, h1, h2, sig) of rows with an id and a text; equal texts have equal h1, h2."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([x for part in in_parts(b.column(1)) for x in sketch(part, slots, k)], pa.binary())], ["doc_id", "h1", "h2", "sig"])

    return _hashed(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, h1 bigint, h2 bigint, sig binary")


@dataclass
class Texts:
    """A vertex for every different text: reps (id, first_id, n, sig), and what is needed to name a row's vertex.

    A vertex is the text's first hash; of the few texts that share one with another, a hash of both hashes.
    """

    reps: DataFrame
    shared: DataFrame

    def named(self, rows: DataFrame) -> DataFrame:
        """rows (h1, h2, ...) with their vertex as id."""
        return with_vertex(rows, self.shared)


def different_texts(docs: DataFrame, id_col: str, text_col: str, slots: int = SLOTS, k: int = SHINGLE) -> Texts:
    one = _sketches(docs, id_col, text_col, slots, k).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    one = saved(one)
    texts = Texts(one, shared_hashes(one))
    texts.reps = texts.named(one)
    return texts


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (id, lead) with both rows' value in table (id, value) as a and b. Few pairs are told to the table's scans, so
    that only rows of pairs move, and once."""
    one, other = table.select("id", F.col(value).alias("a")), table.select(F.col("id").alias("lead"), F.col(value).alias("b"))
    if pairs.count() > FEW:
        return pairs.join(one, "id").join(other, "lead")
    needed = other.join(F.broadcast(pairs.select("lead").distinct()), "lead", "left_semi")
    return one.join(F.broadcast(pairs), "id").join(needed, "lead")


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """(id, lead, similarity) of the pairs (id, lead) that reach the threshold, by signatures first and then exactly."""
    pairs = saved(pairs)
    near = saved(_beside(pairs, sigs, "sig").where(_agreement("a", "b") >= threshold - MARGIN).select("id", "lead"))
    discard(pairs)
    both = _beside(near, texts, "text")
    return both.select("id", "lead", _verifier(k)("a", "b").alias("similarity")).where(F.col("similarity") >= threshold - EPSILON)


def _hot(rows: DataFrame, n: int) -> DataFrame | None:
    """(band) of bands that a share of n / HOT of the ids or more fall into, as a share of them, chosen by hash, shows; None
    where there are none. At most 2 * HOT * BANDS bands can be such: small enough to send to all executors."""
    seen = rows.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(SEEN)) == 0).groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    hot = saved(seen.where(F.col("k") >= max(32, n // (2 * HOT * SEEN))).select("band"))
    return None if hot.isEmpty() else hot


def _several(rows: DataFrame, hot: DataFrame | None, of: str = "id") -> DataFrame:
    """rows (band, id, ...) of bands that hold different values, with the least one as lead.

    The rows of a band meet by one shuffle; those of hot bands don't: their values are counted by partial sums and told to
    the rows where they are.
    """
    bucket = Window.partitionBy("band")
    cold = rows if hot is None else rows.join(F.broadcast(hot), "band", "left_anti")
    cold = cold.withColumn("lead", F.min(of).over(bucket)).withColumn("last", F.max(of).over(bucket)).where("lead <> last").drop("last")
    if hot is None:
        return cold
    warm = rows.join(F.broadcast(hot), "band")
    mixed = warm.groupBy("band").agg(F.min(of).alias("lead"), F.max(of).alias("last")).where("lead <> last")
    return cold.unionByName(warm.join(F.broadcast(mixed.select("band", "lead")), "band"))


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n smallest ids of each group with their rank n; every task sends on n of a group at most."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= n)


def _across(open_rows: DataFrame, known: DataFrame, tested: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float, k: int, hot: DataFrame | None = None) -> DataFrame:
    """known, and the verified pairs of rows of one bucket that known doesn't connect and that weren't held against each other.

    Only pairs of different groups are made, so that a large group costs nothing by itself. Groups meet by their first rows
    of the bucket, then by more and more, until they are connected or all of their rows have met.
    """
    root = components(known.select(F.col("lead").alias("a"), F.col("id").alias("b")))
    rows = open_rows.select("band", "id").join(root, "id", "left").select("band", "id", F.coalesce("root", "id").alias("g"))
    rows = saved(_several(rows, hot, "g").drop("lead"))
    of_id = rows.select("id", "g").distinct()
    size = rows.groupBy("band", "g").agg(F.count(F.lit(1)).alias("size"))
    duos = size.select("band", F.col("g").alias("ga"), F.col("size").alias("sa")).join(size.select("band", F.col("g").alias("gb"), F.col("size").alias("sb")), "band")
    duos = saved(duos.where("ga < gb").select("band", "ga", "gb", F.greatest("sa", "sb").alias("size")))
    links, before, upto = None, 0, FIRST
    while not duos.isEmpty():
        some = _first(rows, ["band", "g"], upto)
        pairs = duos.join(some.select("band", F.col("g").alias("ga"), F.col("id").alias("x"), F.col("n").alias("nx")), ["band", "ga"])
        pairs = pairs.join(some.select("band", F.col("g").alias("gb"), F.col("id").alias("y"), F.col("n").alias("ny")), ["band", "gb"])
        pairs = pairs.where(F.greatest("nx", "ny") > before).select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("lead")).distinct()
        found = saved(_verified(pairs.join(tested, ["id", "lead"], "left_anti"), sigs, texts, threshold, k))
        known = known.unionByName(found)
        left = duos.where(F.col("size") > upto)  # of the others all rows have met
        if left.isEmpty():
            break
        met = found.join(of_id.withColumnRenamed("g", "a"), "id").join(of_id.select(F.col("id").alias("lead"), F.col("g").alias("b")), "lead").select("a", "b").distinct()
        links = saved(met if links is None else links.unionByName(met))
        label = components(links)
        left = left.join(label.select(F.col("id").alias("ga"), F.col("root").alias("ra")), "ga", "left").join(label.select(F.col("id").alias("gb"), F.col("root").alias("rb")), "gb", "left")
        left = saved(left.where(F.coalesce("ra", "ga") != F.coalesce("rb", "gb")).select("band", "ga", "gb", "size"))
        discard(duos, label)
        duos = left
        before, upto = upto, upto * FIRST
    return known


def near_pairs(docs: DataFrame, vertices: Texts, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, k: int = SHINGLE, slots: int = SLOTS) -> DataFrame:
    """(a, b, similarity): verified pairs of vertices that share a band; what their groups connect isn't expanded into all pairs."""
    reps = vertices.reps.where("sig is not null").select("id", "sig")
    size = 4 * rows
    bands = F.array(*(F.xxhash64(F.substring("sig", 1 + i * size, size), F.lit(i)) for i in range(slots // rows)))
    rows_of = reps.select("id", F.explode(bands).alias("band"))
    hot = _hot(rows_of, reps.count())
    open_rows = saved(_several(rows_of, hot))
    ids = open_rows.select("id").distinct()
    firsts = vertices.reps.join(ids, "id", "left_semi").select("h1", "h2", F.col("first_id").alias("doc_id"), "id")
    key = ["doc_id", "h1", "h2"]  # of one vertex at most, so that repeated rows fall away where the join has put them
    texts = saved(_hashed(docs, id_col, text_col).join(firsts, key).dropDuplicates(key).select("id", "text"))
    sigs = saved(reps.select("id", _short("sig").alias("sig")).join(ids, "id", "left_semi"))
    known, leaders, pending, tested = None, 1, open_rows, []
    while True:
        if leaders > 1:
            lead = saved(_first(pending.select("band", "id"), ["band"], leaders).select("band", F.col("id").alias("lead")))
            held = pending.select("band", "id").join(lead, "band").where("id > lead").select("band", "id", "lead")
        else:
            lead = None
            held = pending.where("id > lead").select("band", "id", "lead")
        held = saved(held)
        tested.append(held.select("id", "lead"))
        pairs = held.select("id", "lead").distinct()
        if known is not None:
            pairs = pairs.join(known.select("id", "lead"), ["id", "lead"], "left_anti")
        found = saved(_verified(pairs, sigs, texts, threshold, k))
        edges = found if known is None else known.unionByName(found)
        # a row matched by one leader of its bucket is settled there, and so are the leaders
        joined = held.join(edges.select("id", "lead", F.lit(1).alias("ok")), ["id", "lead"], "left")
        left = joined.groupBy("band", "id").agg(F.max("ok").alias("ok")).where("ok is null").select("band", "id")
        if lead is not None:
            left = left.join(lead.select("band", F.col("lead").alias("id")), ["band", "id"], "left_anti")
        known, pending, leaders = edges, saved(_several(left, hot)), leaders * 2
        if pending.isEmpty():
            break
    known = _across(open_rows, known, reduce(DataFrame.unionByName, tested), sigs, texts, threshold, k, hot)
    return known.select(F.col("lead").alias("a"), F.col("id").alias("b"), "similarity")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest identifier that edges (a, b) reach; minimum labels spread, with jumps to the label's label."""
    both = saved(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = saved(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")))
    while True:
        heard = both.join(label.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        new = label.join(heard, "x").select("x", F.least("root", "r").alias("new"), F.col("root").alias("old"))
        jump = label.select(F.col("x").alias("new"), F.col("root").alias("to"))
        new = saved(new.join(jump, "new").select("x", F.least("to", "new").alias("root"), (F.least("to", "new") != F.col("old")).alias("changed")))
        settled = new.where("changed").isEmpty()
        discard(label)
        label = new
        if settled:
            discard(both)
            return label.select(F.col("x").alias("id"), "root")


def _fates(docs: DataFrame, threshold: float, id_col: str, text_col: str, how: dict[str, int]) -> tuple[Texts, DataFrame]:
    """The vertices, and (id, kept_id, kept) of those whose group holds more than one row: the row that stands for it."""
    vertices = different_texts(docs, id_col, text_col, **{x: how[x] for x in ("slots", "k") if x in how})
    root = components(near_pairs(docs, vertices, threshold, id_col, text_col, **how).select("a", "b"))
    of = vertices.reps.select("id", "first_id", "n").join(root, "id", "left").select("id", "first_id", "n", F.coalesce("root", "id").alias("root"))
    of = saved(of)
    top = of.groupBy("root").agg(F.min(F.struct("first_id", "id")).alias("top"), F.sum("n").alias("n")).where("n > 1")
    return vertices, saved(of.join(top.drop("n"), "root").select("id", F.col("top.first_id").alias("kept_id"), F.col("top.id").alias("kept")))


def _gone(docs: DataFrame, threshold: float, id_col: str, text_col: str, how: dict[str, int]) -> DataFrame:
    """(kept_id, doc_id, h1, h2) of the rows that another row stands for, each once."""
    vertices, fate = _fates(docs, threshold, id_col, text_col, how)
    rows = vertices.named(_hashed(docs, id_col, text_col).select("doc_id", "h1", "h2"))
    return rows.join(fate, "id").where("doc_id <> kept_id or id <> kept").select("kept_id", "doc_id", "h1", "h2").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """(kept_id, doc_id): every document that repeats another, with the smallest identifier of its group.

    A document is an id and a text, so that an id with several texts counts with each of them, and may come more than once.
    Groups are those that verified pairs (J_P >= threshold) and equal texts connect; of equal ids in a group the text of
    smaller hash stands for it. Rows with a null id or text take no part; texts without words (empty ones too) repeat only
    equal texts; repeated rows are one; a pair at the threshold itself is in; long texts count whole; other columns are
    not read; an empty table gives no rows.
    """
    gone = _gone(docs, threshold, id_col, text_col, how)
    return gone.where("doc_id <> kept_id").select("kept_id", "doc_id").distinct()


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs' rows and columns with one document (an id and a text) of each group that near_duplicates finds.

    Rows with a null id stay, so do rows with a null text; of rows with the same id and text one stays, the first by its
    columns' JSON; empty texts repeat each other, so one stays; an id's texts that aren't alike all stay; texts are read
    whole; ties go to the smallest id. docs' columns may have any names; an empty table gives no rows.
    """
    t, i = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    gone = saved(_gone(docs, threshold, id_col, text_col, how))
    keys = _hashed(docs, id_col, text_col).groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = saved(keys.join(gone, ["doc_id", "h1", "h2"], "left_anti"))
    key = [free_name(docs, x) for x in ("k_id", "k_h1", "k_h2")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumns(dict(zip(key, (i, F.xxhash64(t), F.xxhash64(t, F.lit(7)))))).where(i.isNotNull() & t.isNotNull())
    apart = gone.select("doc_id", "h1", "h2").unionByName(several).toDF(*key)
    # few keys go to the documents; of more, which move with them, the join is by shuffle
    told = F.broadcast if apart.count() <= FEW else (lambda keys: keys)
    rest = named.join(told(apart), key, "left_anti").select(*columns)
    row = free_name(docs, "row")
    one = named.join(told(several.toDF(*key)), key, "left_semi").groupBy(*(F.col(f"`{x}`") for x in key)).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(row))
    return rest.unionByName(one.select(*(F.col(f"`{row}`.`{c}`") for c in docs.columns))).unionByName(docs.where(i.isNull() | t.isNull()))
