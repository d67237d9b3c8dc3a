import random

import numpy as np
import pytest
from pyspark.sql import types as T

from wordloom.llm import minhash as m


def prose(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


def variant(r, words, share):
    return [f"x{r.randrange(999)}" if r.random() < share else w for w in words]


def brute_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        c = {}
        for i in range(max(len(w) - 2, 1) if w else 0):
            c[tuple(w[i : i + 3])] = c.get(tuple(w[i : i + 3]), 0) + 1
        out.append(c)
    return out


def brute_jp(v, w):
    every = set(v) | set(w)
    return sum(1 / sum(max(v.get(e, 0) / v[d], w.get(e, 0) / w[d]) for e in every) for d in set(v) & set(w))


def brute_groups(ids, texts, threshold):
    sets, root = brute_sets(texts), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if texts[a] == texts[b] or sets[a] and sets[b] and brute_jp(sets[a], sets[b]) >= threshold:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {(find(i), i) for i in ids if find(i) != i}


def test_exact_measure_and_estimate():
    r = random.Random(1)
    base = prose(r, 150)
    texts = [" ".join(variant(r, base, s) + prose(r, 20) * 2) for s in (0, 0.02, 0.05, 0.1, 0.3)] + ["a b", "a b", ""]
    sets, own = brute_sets(texts), m._shingle_sets(texts, 3)
    sig = [np.frombuffer(b, np.uint32) if b else None for b in m.sketch(texts, slots=1024)]
    for a in range(len(texts)):
        for b in range(a):
            want = brute_jp(sets[a], sets[b])
            assert m.probability_jaccard(own[a], own[b]) == pytest.approx(want)
            if sig[a] is not None and sig[b] is not None:
                assert abs((sig[a] == sig[b]).mean() - want) < 0.08


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    texts = []
    shared = prose(r, 40)
    for _ in range(12):
        base = prose(r, 120)
        texts += [" ".join(variant(r, base, s)) for s in (0, 0, 0.01, 0.02)]
    texts += [" ".join(shared + prose(r, 80)) for _ in range(12)] + [" ".join(prose(r, 100)) for _ in range(10)]
    r.shuffle(texts)
    return list(range(10, 10 + len(texts))), texts


@pytest.mark.parametrize("rows", [3, 1])
def test_groups_match_brute_force(spark, corpus, rows):
    ids, texts = corpus
    got = m.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), rows=rows)
    assert {tuple(r) for r in got.collect()} == brute_groups(ids, texts, m.THRESHOLD)


def test_hot_bands(spark, corpus, monkeypatch):
    ids, texts = corpus
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows = spark.createDataFrame([(b, i) for b in range(5) for i in range(200 if b < 2 else 1 + b)] + [(9, 7)] * 300, "band long, id long")
    monkeypatch.setattr(m, "SEEN", 1)
    hot = m._hot(rows, 200)
    assert {x.band for x in hot.collect()} == {0, 1, 9}
    want = sorted((b, i, 0) for b in range(5) for i in range(200 if b < 2 else 1 + b))
    for h in (hot, None):
        assert sorted(map(tuple, m._several(rows, h).select("band", "id", "lead").collect())) == want
    every = m._hot
    monkeypatch.setattr(m, "_hot", lambda rows, n: rows.select("band").distinct().where("band % 2 = 0"))
    assert {tuple(r) for r in m.near_duplicates(df).collect()} == brute_groups(ids, texts, m.THRESHOLD)
    assert every(rows, 10**9) is None


def test_rows_tied_through_one_that_a_leader_settled(spark):
    r = random.Random(3)
    own = lambda n, i: [f"t{i}x{j}" for j in range(n)]
    b = prose(r, 90)
    # b matches whichever text leads its buckets, c matches b only
    texts = [" ".join(b + own(60, i)) for i in range(150)] + [" ".join(b), " ".join(b[:70] + own(20, "c"))]
    ids = list(range(len(texts)))
    sets = brute_sets(texts)
    assert all(brute_jp(sets[i], sets[-2]) >= 0.5 > brute_jp(sets[i], sets[-1]) for i in (0, 1, 149)) and brute_jp(sets[-2], sets[-1]) >= 0.5
    got = m.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(0, i) for i in ids[1:]]


def test_unconnected_groups_of_a_bucket_meet_in_turns(spark):
    # two groups of 20 share a bucket; only their last rows are near
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30))) if i in (19, 39) else (i, f"a{i} b{i} c{i}") for i in range(40)], "id long, text string")
    sigs = texts.select("id", m.F.udf(lambda t: bytes(m.sketch([t])[0]), "binary")("text").alias("sig"))
    known = spark.createDataFrame([(i, i // 20 * 20, 1.0) for i in range(40) if i % 20], "id long, lead long, similarity double")
    rows = spark.createDataFrame([(7, i) for i in range(40)], "band long, id long")
    got = m._across(rows, known, known.select("id", "lead").limit(0), sigs, texts, 0.5, 3)
    assert {(x.lead, x.id) for x in got.collect()} == {(i // 20 * 20, i) for i in range(40) if i % 20} | {(19, 39)}


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("h1", T.StringType()), ("copy", T.LongType()), ("Rep", T.StringType()))])


def test_odd_rows(spark):
    long = " ".join(f"v{i % 977}" for i in range(400_000))
    rows = [(1, "a b c d", "x", 1, None), (1, "a b c d", "x", 1, None), (2, "a b c d", None, 2, "r"), (None, "a b c d", None, 3, "r"), (3, None, None, 4, "r"), (4, None, None, 4, "r"), (5, "", None, 5, "r"), (6, "", None, 5, "r"), (7, "!!!", None, 5, "r"), (8, long, None, 1, "r"), (9, long + " end", None, 1, "r"), (10, "one", None, 1, "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, m.near_duplicates(docs).collect())) == [(1, 2), (5, 6), (8, 9)]
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 3, 4, 5, 7, 8, 10], key=str)
    assert m.near_duplicates(docs.limit(0)).collect() == [] and m.keep_one(docs.limit(0)).collect() == []


def test_ids_shared_by_different_texts(spark):
    r = random.Random(9)
    a, b, c = (" ".join(prose(r, 60)) for _ in range(3))
    near_b, near_a = b + " tail", a + " tail"
    rows = [(1, a), (1, b), (2, c), (3, near_b), (4, c), (2, near_a), (5, a), (5, near_a), (5, near_a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # groups of rows: {1a, 2near_a, 5a, 5near_a}, {1b, 3near_b}, {2c, 4c}
    assert sorted(map(tuple, m.near_duplicates(docs).collect())) == [(1, 2), (1, 3), (1, 5), (2, 4)]
    assert sorted(map(tuple, m.keep_one(docs).collect())) == sorted([(1, a), (1, b), (2, c)])


def test_vertices_of_texts_that_share_a_hash(spark):
    one = spark.createDataFrame([(5, 1, 10), (5, 2, 11), (6, 1, 12)], "h1 long, h2 long, first_id long")
    named = m.Texts(one, spark.createDataFrame([(5, 1)], "h1 long, keep long")).named(one)
    got = {(x.h1, x.h2): x.id for x in named.collect()}
    assert got[(5, 1)] == 5 and got[(6, 1)] == 6 and len(set(got.values())) == 3


def test_ties_at_the_threshold_and_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d", "u"), (3, "a b c d", "t"), (1, "a b c d", "z"), (2, "k l m", "y"), (2, "k l m", "x"), (2, "k l m", "x")], "doc_id long, text string, k_id string")
    assert sorted(map(tuple, m.near_duplicates(docs).collect())) == [(1, 3)]
    assert sorted(map(tuple, m.keep_one(docs).collect())) == [(1, "a b c d", "z"), (2, "k l m", "x")]
    # J_P of {abc, bcd} and {abc, xyz...}: exactly one half is in
    half = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e f")], "doc_id long, text string")
    sets = brute_sets(["a b c d", "a b c d e f"])
    assert brute_jp(*sets) == pytest.approx(0.5)
    assert sorted(map(tuple, m.near_duplicates(half, rows=1).collect())) == [(1, 2)]
