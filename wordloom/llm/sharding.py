"""Operator 1: shards of even bytes by Karmarkar-Karp differencing, without dividing groups.

The two partial partitions of largest spread are combined, the one's fullest subset with the other's emptiest, until
one is left. That runs in buckets of groups on the executors; each gives a partial partition, and these are combined by
the same step, FAN at a time, level by level. Nothing but one level's subset sums meets in a task.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import saved

SHARDS = 64
#: Groups that one task differences on average, and partial partitions that one combines.
BUCKET, FAN = 50_000, 64


def differencing(parts: np.ndarray) -> np.ndarray:
    """parts: (n, k) subset sums of n partial partitions, any order within a row. Gives (n, k): the final subset of each
    row's subsets. Ties are taken in the order of rows."""
    n, k = parts.shape
    order0 = np.argsort(-parts, axis=1, kind="stable")
    rows = np.take_along_axis(parts, order0, 1)
    sums = dict(enumerate(rows - rows[:, -1:]))
    heap = [(-int(s[0]), i) for i, s in sums.items()]
    heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heappop(heap)
        _, b = heappop(heap)
        s = sums.pop(a) + sums.pop(b)[::-1]
        p = np.argsort(-s, kind="stable")
        s = s[p]
        s -= s[-1]
        node = n + len(made)
        made.append((a, b, p))
        sums[node] = s
        heappush(heap, (-int(s[0]), node))
    label: dict[int, np.ndarray] = {n + len(made) - 1: np.arange(k)}
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, p = made[node - n]
        own = label.pop(node)
        left = np.empty(k, np.int64)
        left[p] = own
        label[a], label[b] = left, left[::-1]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order0[i]] = label[i]
    return out


def split(sizes: np.ndarray, k: int) -> np.ndarray:
    """The subset of each single item; sizes are whole numbers."""
    n = len(sizes)
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    out = np.zeros(n, np.int64)
    # an item is a partial partition with one full subset: the rows aren't held, only what merging makes of them
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapify(heap)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []

    def take(i: int) -> np.ndarray:
        if i >= n:
            return sums.pop(i)
        s = np.zeros(k, np.int64)
        s[0] = sizes[i]
        return s

    while len(heap) > 1:
        _, a = heappop(heap)
        _, b = heappop(heap)
        s = take(a) + take(b)[::-1]
        p = np.argsort(-s, kind="stable")
        s = s[p]
        s -= s[-1]
        node = n + len(made)
        made.append((a, b, p.astype(np.int32)))
        sums[node] = s
        heappush(heap, (-int(s[0]), node))
    if not made:
        return out
    label: dict[int, np.ndarray] = {n + len(made) - 1: np.arange(k, dtype=np.int32)}
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, p = made[node - n]
        left = np.empty(k, np.int32)
        left[p] = label.pop(node)
        for child, own in ((a, left), (b, left[::-1])):
            if child < n:
                out[child] = own[0]
            else:
                label[child] = own
    return out


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """groups (g, bytes): (g, shard). Written to the shared folder at each level."""
    n = groups.count()
    buckets = max(1, -(-n // bucket))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True])
        slot = split(pdf["bytes"].to_numpy(np.int64), shards)
        return pd.DataFrame({"node": pdf["node"], "g": pdf["g"], "slot": slot, "bytes": pdf["bytes"]})

    items = groups.withColumn("node", F.pmod(F.xxhash64("g", F.lit(3)), F.lit(buckets)))
    placed = saved(items.groupBy("node").applyInPandas(within, "node bigint, g bigint, slot bigint, bytes bigint"))
    if buckets == 1:
        return placed.select("g", F.col("slot").cast("int").alias("shard"))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(pdf["node"].unique())
        sums = np.zeros((len(nodes), shards), np.int64)
        sums[np.searchsorted(nodes, pdf["node"]), pdf["slot"]] = pdf["bytes"]
        final = differencing(sums)
        return pd.DataFrame({"node": np.repeat(nodes, shards), "slot": np.tile(np.arange(shards), len(nodes)), "up": pdf["up"].iloc[0], "to": final.ravel(), "bytes": sums.ravel()})

    sums, above = placed.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes")), buckets
    where: DataFrame | None = None  # of each bucket's subsets, the subset of the level reached
    while above > 1:
        above = -(-above // fan)
        level = saved(sums.withColumn("up", F.pmod(F.col("node"), F.lit(above))).groupBy("up").applyInPandas(combine, "node bigint, slot bigint, up bigint, to bigint, bytes bigint"))
        step = level.select("node", "slot", "up", "to")
        if where is None:
            where = step
        else:
            where = where.join(step.select(F.col("node").alias("up"), F.col("slot").alias("to"), F.col("up").alias("up2"), F.col("to").alias("to2")), ["up", "to"]).select("node", "slot", F.col("up2").alias("up"), F.col("to2").alias("to"))
        sums = level.groupBy(F.col("up").alias("node"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
    return placed.join(where, ["node", "slot"]).select("g", F.col("to").cast("int").alias("shard"))


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = (), bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """(doc_id, n_bytes, shard) for every row; rows of a group share a shard, and shards' bytes come out close to even.

    Groups are the rows equal in group_cols, by default equal in text, so that copies stay together. A null or empty
    text has 0 bytes; null texts are one group, so are rows whose group columns are all null; null ids and repeated
    rows keep a row each; very long texts are only measured; equal sizes go in the order of the groups' hashes, so that the result is always the same; a
    group larger than a shard's share has a shard to itself; other columns are not read; an empty table gives no rows.
    """
    key = [F.col(f"`{c}`") for c in group_cols or (text_col,)]
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint")
    rows = saved(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(*key).alias("g"), size.alias("n_bytes")))
    groups = saved(rows.groupBy("g").agg(F.sum("n_bytes").alias("bytes")))
    return rows.join(assign(groups, n_shards, bucket, fan), "g").select("doc_id", "n_bytes", "shard")
