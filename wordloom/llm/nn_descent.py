"""Operator 9: near-duplicate embeddings by NN-descent.

A graph of each vector's K nearest neighbours found so far is refined: whoever are neighbours of one vector, either way,
are held against each other, and a vector keeps the nearest of what it had and what it met, until a round changes next to
nothing. Vectors are dealt to blocks along random directions to begin with, where each is held against all others of its
block. A vector whose list is full of threshold edges may have more: its list is twice as long in the next round, up to
MOST places. What then is still saturated lies in a dense group, and is held against all vectors of its class in blocks:
its links are counted there and not listed, so that a dense group doesn't fill the graph with all of its pairs.

In the end two lots of vectors, of all and of those with links, are held against all others and the recall of the links
is measured; below the target, lists and MOST grow and the rounds go on, in the end to lists that hold everything.

Vectors equal to each other are one in the graph and counted by their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import bounded_sample, discard, saved, shared_hashes, with_vertex
from wordloom.llm.minhash import components

#: Cosine from which two vectors are near-duplicates, and how far float32 may be off.
THRESHOLD, EPSILON = 0.9, 1e-6
#: Places of a list at first, and at most before a saturated vector's links are counted in blocks.
K, MOST = 10, 80
#: Vectors that a block of the start holds on average, and the random directions it is found by, each giving a deal.
BLOCK, DEALS = 512, 4
#: Neighbours either way that meet at one vector at once; more are dealt to parts, another deal each round.
HUB = 1024
#: Vectors on each side of a block in which a dense class is counted.
SIDE = 2048
#: Shares of threshold edges and of all list places that may still be new when the rounds end.
SETTLED, MOVING = 0.002, 0.1
#: Recall that the audit asks for, and vectors that each of its lots takes.
RECALL, AUDIT = 0.95, 400


def _matrix(c: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(c), np.float32).reshape(len(c), -1)


def _vectors(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(key, v, h1, h2): unit vectors as float32 bytes; without null ids and null, empty, zero or not finite vectors."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    narrow = embeddings.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{vec_col}`").cast("array<float>").alias("e")).where("key is not null and size(e) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            off = (off - off[0]).astype(np.int64)
            norm = np.sqrt(np.add.reduceat(np.append(flat * flat, 0), off[:-1])) if len(off) > 1 else np.zeros(0)
            take = np.flatnonzero((norm > 0) & np.isfinite(norm))
            unit = flat.copy() if not len(norm) else flat / np.repeat(np.where(norm > 0, norm, 1), np.diff(off))
            unit = (unit + 0.0).astype(np.float32)  # minus zero is zero
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), pa.array([unit[off[i] : off[i + 1]].tobytes() for i in take.tolist()], pa.binary())], ["key", "v"])

    made = narrow.mapInArrow(run, f"key {kind}, v binary")
    return made.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(3)))


def _best(s: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of each row's k[row] greatest values above -2."""
    most = int(min(k.max(initial=1), s.shape[1]))
    near = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    val = np.take_along_axis(s, near, 1)
    order = np.argsort(-val, axis=1, kind="stable")
    near, val = np.take_along_axis(near, order, 1), np.take_along_axis(val, order, 1)
    r, c = np.nonzero((np.arange(most) < k[:, None]) & (val > -2))
    return r, near[r, c], val[r, c]


def _start(vectors: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """(id, nb, sim) from blocks along random directions: signs of as many directions as give blocks of BLOCK vectors."""
    bits = max(0, math.ceil(math.log2(max(n / BLOCK, 1))))
    planes = np.random.default_rng(7).normal(size=(DEALS, max(bits, 1), dim)).astype(np.float32)

    @F.arrow_udf("array<bigint>")
    def blocks(v: pa.Array) -> pa.Array:
        m = _matrix(v.to_pylist())
        out = np.stack([((m @ p.T > 0) @ (1 << np.arange(len(p)))) + (d << 40) if bits else np.full(len(m), d << 40) for d, p in enumerate(planes)], axis=1)
        return pa.array(out.tolist(), pa.list_(pa.int64()))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = pdf["id"].to_numpy(), _matrix(pdf["v"])
        parts = []
        for a in range(0, len(ids), 512):
            s = m[a : a + 512] @ m.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -3
            r, c, v = _best(s, np.full(len(s), k))
            parts.append(pd.DataFrame({"id": ids[r + a], "nb": ids[c], "sim": v.astype(np.float32)}))
        return pd.concat(parts)

    # a block that fell out large is dealt further by hash: its parts meet again through neighbours of neighbours
    dealt = vectors.withColumn("block", F.explode(blocks("v")))
    size = dealt.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("parts"))
    dealt = dealt.join(size, "block").withColumn("part", F.pmod(F.xxhash64("id", "block"), F.col("parts")))
    return dealt.select("block", "part", "id", "v").groupBy("block", "part").applyInPandas(within, "id bigint, nb bigint, sim float").distinct()


def _nearest(pairs: DataFrame, size: DataFrame, limit: int) -> DataFrame:
    """Of (id, nb, sim, fresh) the nearest of each id, as many as its size says; limit is the largest size, and as many of an
    id a task sends on at most."""
    one = pairs.groupBy("id", "nb").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "nb"))
    return one.withColumn("n", rank).where(F.col("n") <= limit).join(size, "id").where("n <= k").select("id", "nb", "sim", "fresh")


def _among(ids: np.ndarray, m: np.ndarray, new: np.ndarray, worst: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one vector's neighbours that better a list, at least one of the two fresh; of each no more than its list holds."""
    for a in range(0, len(ids), 1024):
        s = m[a : a + 1024] @ m.T
        ok = s > worst[a : a + 1024, None]
        ok &= new[a : a + 1024, None] | new[None, :]
        ok[np.arange(len(s)), np.arange(a, a + len(s))] = False
        r, c, v = _best(np.where(ok, s, -3), k[a : a + 1024])
        yield ids[r + a], ids[c], v


def _meet(graph: DataFrame, state: DataFrame, vectors: DataFrame, turn: int) -> DataFrame:
    """(id, nb, sim) among each vector's neighbours, either way, where one of the two is fresh.

    The rows of a vector's neighbours come together by one shuffle and pass through Arrow in the order of the vectors. A
    vector that very many have in their lists has its neighbours dealt to parts of HUB, in each turn otherwise.
    """
    hops = graph.select(F.col("id").alias("c"), F.col("nb").alias("x"), "fresh").unionByName(graph.select(F.col("nb").alias("c"), F.col("id").alias("x"), "fresh"))
    hops = hops.groupBy("c", "x").agg(F.max("fresh").alias("fresh"))
    live = hops.groupBy("c").agg(F.max("fresh").alias("live"), F.ceil(F.count(F.lit(1)) / HUB).alias("parts")).where("live").drop("live")  # else all have met
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("c", "x", F.lit(turn)), F.col("parts"))).otherwise(F.lit(0))
    told = vectors.select(F.col("id").alias("x"), "v").join(state.select(F.col("id").alias("x"), "worst", "k"), "x")
    rows = hops.join(live, "c").withColumn("c", F.xxhash64("c", part)).select("c", "x", "fresh").join(told, "x").select("c", "x", "fresh", "v", "worst", "k").repartition("c").sortWithinPartitions("c")

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c, x = t.column("c").to_numpy(), t.column("x").to_numpy()
        m = _matrix(t.column("v").to_pylist())
        new, worst, k = t.column("fresh").to_numpy().astype(bool), t.column("worst").to_numpy(), t.column("k").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]]).tolist()
        got, size = [], 0
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                for part in _among(x[a:b], m[a:b], new[a:b], worst[a:b], k[a:b]):
                    if len(part[0]):
                        got.append(part)
                        size += len(part[0])
            if size > 500_000 or b == len(c) and got:
                i, j, s = (np.concatenate(z) for z in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s.astype(np.float32))], ["id", "nb", "sim"])
                got, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            c = t.column("c")
            first = int(np.searchsorted(c.to_numpy(), c[-1].as_py(), "left"))  # the last vector's rows may go on
            if first:
                yield from groups(t.slice(0, first).combine_chunks())
            held = t.slice(first)
        if held is not None and held.num_rows:
            yield from groups(held.combine_chunks())

    return rows.mapInArrow(run, "id bigint, nb bigint, sim float")


def _counted(dense: DataFrame, root: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, links) of the vectors (id) of dense: how many rows of their class are within the threshold, counted block by block."""
    named = root.join(dense.withColumn("asks", F.lit(True)), "id", "left")
    sizes = named.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks"), F.max("asks").alias("asks")).where("asks").drop("asks")
    rows = vectors.join(named.join(sizes, "root"), "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    told = rows.select("root", other.alias("a"), F.col("own").cast("int").alias("b"), "id", "n", "v", F.lit(False).alias("asks"))
    asked = rows.where("asks").select("root", F.col("own").cast("int").alias("a"), other.alias("b"), "id", "n", "v", F.lit(True).alias("asks"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(q) or not len(t):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        m, weight, own = _matrix(t["v"]), t["n"].to_numpy(), t["id"].to_numpy()
        out = []
        for a in range(0, len(q), 512):
            near = _matrix(q["v"].iloc[a : a + 512]) @ m.T >= threshold - EPSILON
            near &= q["id"].to_numpy()[a : a + 512, None] != own[None, :]
            out.append(near @ weight)
        return pd.DataFrame({"id": q["id"].to_numpy(), "links": np.concatenate(out)})

    return told.unionByName(asked).groupBy("root", "a", "b").applyInPandas(count, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def _links(graph: DataFrame, size: DataFrame, vectors: DataFrame, threshold: float, most: int) -> DataFrame:
    """(id, root, links) of vectors with threshold edges: the class, and the number of rows of other vectors linked to them."""
    near = graph.where(F.col("sim") >= threshold - EPSILON).select("id", "nb")
    edges = saved(near.unionByName(near.select(F.col("nb").alias("id"), F.col("id").alias("nb"))).distinct())
    root = components(edges.select(F.col("id").alias("a"), F.col("nb").alias("b")))
    listed = edges.join(vectors.select(F.col("id").alias("nb"), "n"), "nb").groupBy("id").agg(F.sum("n").alias("links"))
    have = graph.groupBy("id").agg(F.count(F.lit(1)).alias("have"), F.min("sim").alias("worst"))
    dense = saved(have.join(size, "id").where((F.col("have") >= F.col("k")) & (F.col("k") >= most) & (F.col("worst") >= threshold - EPSILON)).select("id"))
    if not dense.isEmpty():
        exact = _counted(dense, root, vectors, threshold).withColumnRenamed("links", "exact")
        listed = listed.join(exact, "id", "left").select("id", F.coalesce("exact", "links").alias("links"))
    return saved(listed.join(root, "id"))


def _audit(vectors: DataFrame, links: DataFrame, n: int, threshold: float, rows: int) -> tuple[int, int]:
    """(links that audited vectors have by brute force; how many of them were found): vectors chosen by hash, of all and of
    those with links."""
    lot = lambda df, total: bounded_sample(df, rows, F.xxhash64("id", F.lit(11)), total)
    some = lot(links.select("id"), None).join(vectors.select("id", "v"), "id").select("id", "v")
    asked = lot(vectors.select("id", "v"), n).unionByName(some).dropDuplicates(["id"]).orderBy("id").collect()
    if not asked:
        return 0, 0
    ids, m = np.array([r["id"] for r in asked], np.int64), _matrix([bytes(r["v"]) for r in asked])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            near = m @ _matrix(b.column(1).to_pylist()).T >= threshold - EPSILON
            near &= ids[:, None] != b.column(0).to_numpy()[None, :]
            total += near @ b.column(2).to_numpy()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], ["id", "n"])

    true = {r["id"]: r["n"] for r in vectors.select("id", "v", "n").mapInArrow(scan, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    had = {r["id"]: r["links"] for r in links.where(F.col("id").isin(ids.tolist())).select("id", "links").collect()}
    return sum(true.values()), sum(min(n, had.get(i, 0)) for i, n in true.items())


def links_of(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, most: int = MOST, recall: float = RECALL, audit: int = AUDIT) -> DataFrame:
    """(id, root, links) of the vectors (id, v, n) of one length that have near ones, by NN-descent with the audit passed.

    n is the number of rows that a vector stands for; ids are bigint and each has one vector.
    """
    n = vectors.count()
    first = vectors.select("v").first()
    if n < 2 or first is None:
        return vectors.sparkSession.createDataFrame([], "id bigint, root bigint, links bigint")
    most = max(k, most)
    size = saved(vectors.select("id", F.lit(k).alias("k")))
    graph = saved(_nearest(_start(vectors, n, len(first["v"]) // 4, k).withColumn("fresh", F.lit(True)), size, k))
    turn = 0
    while True:
        turn += 1
        # a list that is full and all within the threshold grows; one with room takes whatever it meets
        have = graph.groupBy("id").agg(F.count(F.lit(1)).alias("have"), F.min("sim").alias("worst"))
        full = F.coalesce(F.col("have") >= F.col("k"), F.lit(False))
        grown = F.when(full & (F.col("worst") >= threshold), F.greatest("k", F.least(F.col("k") * 2, F.lit(most)))).otherwise(F.col("k"))
        state = saved(size.join(have, "id", "left").select("id", grown.alias("k"), F.when(full & (grown == F.col("k")), F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"), (grown > F.col("k")).alias("grows")))
        # a list that grows meets its neighbours' neighbours again, as it turned many away
        again = graph.join(state.where("grows").select("id"), "id", "left_semi").select("id", "nb", "sim", F.lit(True).alias("fresh"))
        seen = graph.unionByName(again).groupBy("id", "nb").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
        met = _meet(seen, state, vectors, turn).withColumn("fresh", F.lit(True))
        new = saved(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(met), state.select("id", "k"), most))
        discard(graph, size)
        graph, size = new, state.select("id", "k")
        size._saved_at = state._saved_at
        sure = F.col("sim") >= threshold
        moved = graph.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh"), F.count_if(sure).alias("near"), F.count_if(sure & F.col("fresh")).alias("fresh_near")).first()
        if moved["fresh_near"] > SETTLED * moved["near"] or moved["fresh"] > MOVING * moved["n"]:
            continue
        have = graph.groupBy("id").agg(F.count(F.lit(1)).alias("have"), F.min("sim").alias("worst"))
        if not size.join(have, "id").where((F.col("k") < most) & (F.col("have") >= F.col("k")) & (F.col("worst") >= threshold)).isEmpty():
            continue
        links = _links(graph, size, vectors, threshold, most)
        true, had = _audit(vectors, links, n, threshold, audit)
        if had >= recall * true:
            return links
        most *= 2
        size = saved(size.select("id", (F.col("k") * 2).alias("k")))
        graph = saved(graph.withColumn("fresh", F.lit(True)))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, k: int = K, most: int = MOST, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links) for every vector: the smallest id of those that links connect it to, itself included, and
    the number of its links.

    A link is another row whose cosine with it is at least the threshold; equal vectors are linked too. A row is an id and
    a vector: repeated rows are one, and an id with several vectors has a row for each. Rows with a null id and null, empty,
    zero or not finite vectors take no part; vectors of different lengths have no links, very long ones are read whole;
    ties in a list go to the smaller vertex; other columns are not read; an empty table gives no rows. Of all links, the
    given share at least is found, as the audit measures it on each run; vectors without links are rows too.
    """
    every = saved(_vectors(embeddings, id_col, vec_col))
    rows = saved(every.groupBy("h1", "h2", "key").agg(F.count(F.lit(1)).alias("copies")).drop("copies"))
    one = saved(every.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(rows.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")), ["h1", "h2"]))
    shared = shared_hashes(one)
    distinct = saved(with_vertex(one, shared).select("id", "v", "first", "n", F.length("v").alias("size")))
    discard(every)
    found = None
    for r in distinct.select("size").distinct().orderBy("size").collect():
        part = links_of(distinct.where(F.col("size") == r["size"]).select("id", "v", "n"), threshold, k, most, recall)
        found = part if found is None else found.unionByName(part)
    named = with_vertex(rows, shared)
    if found is None:
        return named.select(F.col("key").alias("vec_id"), F.col("key").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    of = distinct.select("id", "first", "n").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = saved(of.select("id", "root", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = of.groupBy("root").agg(F.min("first").alias("class_id"))
    return named.join(of.drop("first"), "id").join(least, "root").select(F.col("key").alias("vec_id"), "class_id", "n_links")
