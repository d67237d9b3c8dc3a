import numpy as np
import pytest

from wordloom.llm import nn_descent as nn
from wordloom.llm.common import table


def brute(rows, threshold):
    """(id, class, links) of (id, unit vector) rows, by all pairs."""
    m = np.array([v for _, v in rows])
    near = m @ m.T >= threshold - 1e-6
    np.fill_diagonal(near, False)
    root = np.array([i for i, _ in rows])
    while True:
        new = np.minimum(root, np.where(near, root[None, :], root.max(initial=0)).min(axis=1))
        if (new == root).all():
            return sorted(zip((i for i, _ in rows), root.tolist(), near.sum(axis=1).tolist()))
        root = new


def unit(m):
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def held(got, want, recall=0.95):
    """Every row is there, links are found to the given share and none too many, and classes agree but for few."""
    got = sorted(map(tuple, got))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[2] <= w[2] for g, w in zip(got, want))
    assert sum(g[2] for g in got) >= recall * sum(w[2] for w in want)
    assert sum(g[1] == w[1] for g, w in zip(got, want)) >= 0.98 * len(want)


@pytest.mark.parametrize("k,most", [(4, 8), (10, 80)])
def test_links_with_groups_larger_than_the_lists(spark, k, most, monkeypatch):
    monkeypatch.setattr(nn, "SIDE", 64)  # a dense class is counted in several blocks
    r = np.random.default_rng(k)
    base = r.normal(size=(900, 24))
    groups = [c + 0.12 * r.normal(size=(n, 24)) for c, n in zip(r.normal(size=(40, 24)), [2] * 20 + [5] * 12 + [30] * 6 + [150, 90])]
    m = unit(np.concatenate([base, *groups]))
    m = np.concatenate([m, m[-300::7], m[-1:].repeat(40, 0)])  # copies too
    rows = list(zip((r.permutation(len(m)) + 5).tolist(), m))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    held(nn.near_duplicates(df, k=k, most=most).collect(), brute(rows, nn.THRESHOLD))


def test_whole_table_at_a_threshold_that_has_links(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(x.vec_id, v) for x, v in zip(*(lambda got: (got, unit(np.array([y.embedding for y in got]))))(df.collect()))]
    want = brute(rows, 0.4)
    assert sum(w[2] for w in want) > 20
    held(nn.near_duplicates(df, threshold=0.4).collect(), want, 0.9)


def test_a_vector_that_very_many_have_in_their_lists(spark, monkeypatch):
    monkeypatch.setattr(nn, "HUB", 16)
    r = np.random.default_rng(3)
    m = unit(np.concatenate([r.normal(size=(1, 8)) + 0.05 * r.normal(size=(120, 8)), r.normal(size=(300, 8))]))
    rows = list(enumerate(m))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    held(nn.near_duplicates(df, k=4, most=8).collect(), brute(rows, nn.THRESHOLD))


def test_a_meeting_gives_each_list_its_best():
    r = np.random.default_rng(2)
    m = unit(r.normal(size=(50, 6)))
    new, worst, k = r.random(50) < 0.3, np.full(50, 0.1), r.integers(1, 60, 50)
    got = {}
    for i, j, s in nn._among(np.arange(50), m, new, worst, k):
        for x in zip(i.tolist(), j.tolist(), s.tolist()):
            got.setdefault(x[0], []).append(x[1])
    s = m @ m.T
    for i in range(50):
        fit = [j for j in np.argsort(-s[i]) if j != i and s[i, j] > 0.1 and (new[i] or new[j])][: k[i]]
        assert sorted(got.get(i, [])) == sorted(fit)


def test_start_meets_in_blocks(spark):
    r = np.random.default_rng(2)
    m = unit(r.normal(size=(1500, 8)))
    df = spark.createDataFrame([(i, bytes(v.tobytes())) for i, v in enumerate(m)], "id long, v binary")
    g = nn._start(df, 1500, 8, 5).collect()
    assert len({x.id for x in g}) == 1500 and all(abs(x.sim - m[x.id] @ m[x.nb]) < 1e-5 for x in g)


def test_odd_rows(spark):
    a, b, long = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0] * 30_000
    rows = [(1, a, "x", 1), (2, [2.0, 0.0, 0.0], "x", 1), (2, [2.0, 0.0, 0.0], "x", 1), (3, b, None, 2), (4, [0.1, 1.0, 0.0], None, 2), (None, a, "n", 3), (5, None, "n", 3), (6, [], "n", 3), (7, [0.0, 0.0, 0.0], "n", 3), (8, [float("nan"), 1.0, 0.0], "n", 3), (9, [None, 1.0, 0.0], "n", 3), (10, [1.0, 0.0], "n", 3), (11, [0.0, -1.0, -0.0], "n", 3), (12, long, "n", 3), (13, long, None, None)]
    rows += [(3, [0.0, 0.0, 1.0], "n", 3), (14, [0.05, 0.0, 1.0], "n", 3)]  # an id's second vector is the one with a link
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, SIM int")
    got = sorted(map(tuple, nn.near_duplicates(df).collect()))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (3, 3, 1), (4, 3, 1), (10, 10, 0), (11, 11, 0), (12, 12, 1), (13, 12, 1), (14, 3, 1)]
    assert nn.near_duplicates(df.limit(0)).collect() == []
    assert len(nn.near_duplicates(df.limit(1)).collect()) == 1
