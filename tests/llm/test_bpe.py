import os
import random

import numpy as np
import pytest
import tiktoken
import xxhash  # noqa: F401
from pyspark.sql import types as T

from wordloom.llm import bpe, transducer
from wordloom.llm.common import span_hashes
from wordloom.llm.token_counts import merge_count, token_counts
from wordloom.llm.transducer import Decoder, Encoder, decode_ids, encode_documents, encode_texts, sufficient_lookahead

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason=f"the vocabulary {bpe.VOCABULARY} is not installed")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "é", "ß", "日本", "😀", "1", "42", "!", "...", "\t", " ", "'", "Z", "ing", "<|endoftext|>"]


def brute(text):
    enc = brute.enc = getattr(brute, "enc", None) or tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    return enc.encode_ordinary(text)


def texts(n=300):
    r = random.Random(7)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_identifiers_are_the_librarys():
    given = texts()
    ids, off = encode_texts(given)
    for t, a, b in zip(given, off, off[1:]):
        assert ids[a:b].tolist() == brute(t), t


def test_count_is_symbols_minus_merges():
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    for t in texts():
        if t and not t[:1].isspace():
            whole = t.encode()
            assert len(whole) - merge_count(whole, ranks) == len(transducer.merge_symbols(whole, ranks))


def test_streaming_equals_whole_for_long_pieces():
    r = random.Random(3)
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    for kind in ("abcdefghijklmnopqrstuvwxyz", "ab", "theringsaon", "=-_", "é日"):
        data = "".join(r.choice(kind) for _ in range(3000)).encode()
        whole = [ranks[t] for t in transducer.merge_symbols(data, ranks)]
        e, out = Encoder(), []
        at = 0
        while at < len(data):
            step = r.randrange(1, 400)
            out += e.feed(data[at : at + step])
            assert len(e.held) <= sufficient_lookahead() + 2 * Encoder.STEP + 200
            at += step
        assert out + e.end() == whole


def test_decoding_in_any_parts():
    r = random.Random(5)
    data = "héß日本😀x".encode() * 20 + b"\xff\xe2\x82" + "é".encode() + b"\xf0\x9f"
    for _ in range(50):
        d, out, at = Decoder(), "", 0
        while at < len(data):
            step = r.randrange(1, 5)
            out += d.feed(data[at : at + step])
            assert len(d.tail) <= 3
            at += step
        assert out + d.end() == data.decode("utf-8", "replace")
    ids = brute("héß 日本 😀")
    assert "".join(decode_ids([np.array([i]) for i in ids])) == "héß 日本 😀"


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("token_ids", T.StringType()), T.StructField("N_TOKENS", T.IntegerType())])


@pytest.fixture(scope="module")
def odd(spark):
    long = ("ering thon " * 40_000) + "x" * 30_000
    rows = [(1, "the thing's", "a", 1), (1, "the thing's", "a", 1), (None, "é", None, None), (3, None, "b", 2), (4, "", "c", 3), (5, long, "d", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_handle_odd_rows(spark, odd):
    got = sorted(map(tuple, token_counts(odd).collect()), key=str)
    want = sorted(((r.doc_id, None if r.text is None else len(brute(r.text))) for r in odd.collect()), key=str)
    assert got == want
    assert token_counts(odd.limit(0)).collect() == []


def test_encoding_handles_odd_rows(spark, odd):
    got = encode_documents(odd)
    assert got.columns == ["doc_id", "text", "token_ids", "N_TOKENS", "_token_ids", "_n_tokens", "round_trip"]
    for r in got.collect():
        if r.text is None:
            assert r._token_ids is None and r._n_tokens is None and r.round_trip is None
        else:
            assert r._token_ids == brute(r.text) and r._n_tokens == len(r._token_ids) and r.round_trip
    assert got.count() == 6
    assert encode_documents(odd.limit(0)).collect() == []


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_that_polynomials_confuse(n):
    pair = [thue_morse(n), thue_morse(n, "b", "a")]
    ids, off = encode_texts([*pair, *pair[::-1]])
    assert transducer.decode_rows(ids, off) == [*pair, *pair[::-1]]
    cp = np.frombuffer("".join(pair).encode("utf-32-le"), np.uint32)
    h = span_hashes(cp, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def test_pieces_of_equal_hashes_stay_apart(monkeypatch):
    given = texts()
    want = [brute(t) for t in given]
    monkeypatch.setattr(bpe, "span_hashes", lambda cp, starts, ends: np.zeros(len(starts), np.uint64))
    table = bpe.Pieces(Encoder().piece)
    for part in (given, given[::-1]):
        ids, off = table.items(part)
        got = [ids[a:b].tolist() for a, b in zip(off, off[1:])]
        assert got == (want if part is given else want[::-1])
    assert len(table.slot) == 1 and table.odd
    monkeypatch.setattr(bpe, "TABLE_SIGNS", 10)
    ids, off = table.items(given)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
