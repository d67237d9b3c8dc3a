import random
from heapq import heapify, heappop, heappush

import numpy as np
import pytest

from wordloom.llm import sharding as s


def brute(sizes, k):
    """Differencing with the items' lists carried along."""
    heap = [(-v, i, [(v, [i])] + [(0, [])] * (k - 1)) for i, v in enumerate(sizes)]
    heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heappop(heap)[2], heappop(heap)[2]
        c = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: -t[0])
        c = [(x - c[-1][0], p) for x, p in c]
        heappush(heap, (-c[0][0], n, c))
        n += 1
    return sorted(sorted(p) for _, p in heap[0][2])


@pytest.mark.parametrize("k", [2, 3, 7])
def test_equals_plain_differencing(k):
    r = random.Random(k)
    for n in (1, 2, 5, 60):
        sizes = sorted((r.randrange(1, 50) for _ in range(n)), reverse=True)
        got = s.split(np.array(sizes), k)
        assert sorted(sorted(np.flatnonzero(got == j).tolist()) for j in range(k)) == brute(sizes, k)
        rows = np.zeros((n, k), np.int64)
        rows[:, 0] = sizes
        assert (s.differencing(rows)[:, 0] == got).all()


def greedy(sizes, k):
    load = [0] * k
    for v in sorted(sizes, reverse=True):
        load[load.index(min(load))] += v
    return max(load) - min(load)


def test_tighter_than_greedy():
    r = random.Random(6)
    sizes = np.array(sorted((r.randrange(1000, 90000) for _ in range(800)), reverse=True))
    load = np.bincount(s.split(sizes, 8), sizes, 8)
    assert load.max() - load.min() < greedy(sizes.tolist(), 8)


def test_levels_keep_groups_whole_and_even(spark):
    r = random.Random(3)
    rows = [(i, f"t{i % 700} " * r.choice([1, 5, 40]) if i % 3 else f"copy {i % 30}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.shards(docs, 5, bucket=40, fan=3).collect()
    assert len(got) == 1500
    load, of = {}, {}
    text = dict(rows)
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.n_bytes
        assert of.setdefault(text[x.doc_id], x.shard) == x.shard and x.n_bytes == len(text[x.doc_id])
    assert set(load) == set(range(5)) and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())


def test_odd_rows(spark):
    rows = [(1, "ab", "x", 1), (1, "ab", "x", 1), (None, "ü" * 400_000, "y", 2), (2, None, None, 3), (3, "", None, 3), (4, None, None, 3), (5, "cd", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, g int")
    got = [tuple(r) for r in s.shards(docs, 3).collect()]
    assert sorted(((a, b) for a, b, _ in got), key=str) == sorted([(1, 2), (1, 2), (None, 800_000), (2, 0), (3, 0), (4, 0), (5, 2)], key=str)
    by = {}
    for a, _, c in got:
        by.setdefault(a, set()).add(c)
    assert all(len(v) == 1 for v in by.values()) and by[2] == by[4] and by[None] not in (by[1], by[5])
    assert s.shards(docs.limit(0), 3).collect() == []
    assert {r.shard for r in s.shards(docs, 1).collect()} == {0}
    assert len({r.shard for r in s.shards(docs, 4, group_cols=("g",)).where("doc_id = 1 or doc_id = 5").collect()}) == 1
