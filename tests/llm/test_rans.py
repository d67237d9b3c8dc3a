import random

import numpy as np
import pytest

from wordloom.llm import rans
from wordloom.llm.transducer import encode_texts


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000, rans.STRIDE, rans.STRIDE * 3 + 7])
def test_round_trip_from_every_checkpoint(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n + 500), 999)
    table = rans.Table.of(np.bincount(ids, minlength=1000))
    at = np.array([0, n, n + 300, n + 300, n + 500])
    for (payload, points), a, b in zip(rans.encode(table, ids, at), at, at[1:]):
        assert len(points) == -(-(b - a) // rans.STRIDE)
        for point in points:
            assert (rans.decode(table, payload, [point], [int(b - a)])[0] == ids[a + point[0] : b]).all()
        stops = [p[0] for p in points[1:]] + [int(b - a)]
        together = rans.decode(table, payload, points, stops)
        assert all((x == ids[a + p[0] : a + z]).all() for x, p, z in zip(together, points, stops))


def test_size_is_near_the_entropy():
    r = np.random.default_rng(1)
    ids = np.minimum(r.geometric(0.002, 60_000), 4999)
    c = np.bincount(ids, minlength=5000)
    p = c[c > 0] / len(ids)
    payload = rans.encode(rans.Table.of(c), ids, np.array([0, len(ids)]))[0][0]
    assert len(payload) * 8 < len(ids) * -(p * np.log2(p)).sum() * 1.01


def test_scaled_frequencies():
    for c in ([0, 0, 0], [5], [1, 0, 10**12], [1] * 50_000 + [10**9], [3, 3, 3]):
        t = rans.Table.of(np.array(c))
        assert t.freq.sum() == (1 << rans.SCALE) * (sum(c) > 0) and ((t.freq > 0) == (np.array(c) > 0)).all()
        assert (rans.Table.load(t.dump()).freq == t.freq).all()


def test_documents_and_odd_rows(spark):
    r = random.Random(2)
    long = " ".join(r.choice(["ering", "thon", "of", "the", "x1"]) for _ in range(500_000))
    rows = [(1, "the thing's", "a"), (1, "the thing's", "a"), (None, "é", None), (3, None, "b"), (4, "", "c"), (5, long, "d")] + [(10 + i, "word " * i, "e") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string").repartition(3)
    blocks = rans.encode_documents(docs).cache()
    got = {}
    for x in rans.decode_documents(blocks).collect():
        got.setdefault(x.doc_id, []).append((x.part, x.token_ids))
    ids, off = encode_texts([t for _, t, _ in rows])
    want = {}
    for (i, t, _), a, b in zip(rows, off, off[1:]):
        want.setdefault(i, []).append(None if t is None else ids[a:b].tolist())
    assert got.keys() == want.keys()
    for i, lists in want.items():
        if i == 1:
            assert [x for _, x in got[1]] == lists
        else:
            parts = sorted(got[i], key=lambda p: p[0])
            assert lists[0] == (None if parts[0][1] is None else sum((x for _, x in parts), []))
    assert max(r.n_tokens for r in blocks.collect()) <= rans.BLOCK and len(got[5]) > 1
    empty = rans.encode_documents(docs.limit(0))
    assert empty.count() == 1 and rans.decode_documents(empty).collect() == []


def scalar(table, ids):
    """The coder for one identifier after the other, in whole numbers of any size: (words, checkpoints)."""
    freq, start = [int(x) for x in table.freq], [int(x) for x in table.start]
    low, x, out, points = 1 << 31, [1 << 31] * rans.LANES, [], []
    for i in reversed(range(len(ids))):
        lane, f, c = i % rans.LANES, freq[ids[i]], start[ids[i]]
        if x[lane] >= ((low >> rans.SCALE) << 32) * f:
            out.append(x[lane] % 2**32)
            x[lane] //= 2**32
        x[lane] = (x[lane] // f) * 2**rans.SCALE + x[lane] % f + c
        if i % rans.STRIDE == 0:
            points.append((i, len(out), list(x)))
    return out[::-1], [(i, len(out) - w, s) for i, w, s in reversed(points)]


@pytest.mark.parametrize("n", [0, 1, 128, 1000, 5003])
def test_blocks_are_those_of_a_scalar_coder(n, monkeypatch):
    monkeypatch.setattr(rans, "STRIDE", 1024)
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.003, n + 700), 4000)
    table = rans.Table.of(np.bincount(ids))
    at = np.array([0, n, n + 700])
    for (payload, points), a, b in zip(rans.encode(table, ids, at), at, at[1:]):
        words, want = scalar(table, ids[a:b].tolist())
        assert np.frombuffer(payload, "<u4").tolist() == words
        assert [(i, w, np.frombuffer(s, "<u8").tolist()) for i, w, s in points] == want


def test_damage_is_noticed_in_every_part(monkeypatch):
    monkeypatch.setattr(rans, "STRIDE", 512)
    ids = np.random.default_rng(1).integers(0, 300, 2000)
    table = rans.Table.of(np.bincount(ids))
    payload, points = rans.encode(table, ids, np.array([0, 2000]))[0]
    row = {"n_tokens": 2000, "payload": payload, "table_crc": table.checksum, "token_crc": rans._crc(ids)}
    row["checkpoints"] = [{"first": a, "word": b, "states": c, "crc": rans._crc(ids[a : a + 512])} for a, b, c in points]
    assert (rans.decode_block(table, row) == ids).all() and (rans.decode_block(table, row, range(1, 3)) == ids[512:1536]).all()
    word = points[1][1] * 4 + 40
    broken = row | {"payload": payload[: word + 2] + bytes([payload[word + 2] ^ 8]) + payload[word + 3 :]}
    assert (rans.decode_block(table, broken, range(2, 4)) == ids[1024:]).all()
    for bad, parts in ((broken, None), (broken, range(1, 2)), (row | {"token_crc": 0}, None), (row | {"table_crc": 0}, range(1))):
        with pytest.raises(ValueError):
            rans.decode_block(table, bad, parts)


def test_ties_of_frequency():
    t = rans.Table.of(np.array([7, 7, 0, 7]))
    assert t.freq.tolist() == [349526, 349525, 0, 349525]
