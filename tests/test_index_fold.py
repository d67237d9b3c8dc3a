"""Folding segments: what is dealt by, where it is written, and older blocks."""

import random
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.functions.formats import TEXT, Schema
from wordloom.sources import index as index_module
from wordloom.sources import postings
from wordloom.sources.index import create_in

TEXTS = ["alfa bravo charlie", "bravo bravo", "", None, "alfa alfa delta echo", "echo the bravo"]


@pytest.fixture
def ix(spark, tmp_path):
    out = create_in(spark, str(tmp_path / "ix"), Schema(text=TEXT(stored=True)))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for k in (0, 1):
        w = out.writer()
        w.add_documents(docs.where(F.col("doc_id") % 2 == k))
        w.commit()
    out.delete_document(4)
    return out


def rows(ix):
    return sorted((r.term, r.doc_id, r.tf, r.weight, r.length, *r.positions) for r in ix.postings("text", positions=True).collect())


def never(*_):
    raise AssertionError("not wanted here")


def test_fold_reads_postings_once_and_copies_nothing(spark, ix, tmp_path, monkeypatch):
    """F4, F5"""
    monkeypatch.setattr(index_module, "sample_of", never)
    monkeypatch.setattr(index_module, "copy_to", never)
    want, before = rows(ix), ix.manifest.__dict__.copy()
    out = ix.optimize_to(str(tmp_path / "out"))
    assert rows(out) == want and out.docs().count() == 5 and len(out.refresh().manifest.segments) == 1 and not out.manifest.deletions
    assert ix.refresh().manifest.__dict__ == before and rows(ix) == want
    again = out.optimize_to(str(tmp_path / "again"))  # a fold has what the next one deals by
    assert rows(again) == want
    none = create_in(spark, str(tmp_path / "none"), ix.schema).optimize_to(str(tmp_path / "none2"))
    assert none.is_empty() and none.docs().count() == 0


def test_blocks_of_version_2_are_read_and_folded(spark, ix):
    want = rows(ix)
    for s in ix.manifest.segments:
        lists = postings.opened(spark.read.parquet(f"{ix.path}/{s}/postings_text"), True).collect()
        old = [(r.term, np.array([r.doc_id], "<i8").tobytes(), np.array([r.tf], "<i4").tobytes(), np.array([r.length], "<i4").tobytes(), 1.0, b"", np.array(r.positions, "<i4").tobytes()) for r in lists]
        table = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in old], "term string, doc_ids binary, tfs binary, lengths binary, boost double, weights binary, positions binary")
        table.coalesce(1).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{ix.path}/{s}/postings_text")
        ix.files.delete(f"{s}/terms_text.json")
    assert rows(ix) == want
    ix.optimize()
    assert rows(ix) == want and "tfs" not in spark.read.parquet(f"{ix.path}/{ix.manifest.segments[0]}/postings_text").columns


def test_sketches_keep_sizes(monkeypatch):
    monkeypatch.setattr(postings, "PART_ROWS", 32)
    some = random.Random(1)
    parts = [sorted((some.choice("abcdefgh") * some.randint(1, 4), some.randint(1, 9)) for _ in range(n)) for n in (0, 1, 3, 200)] + [[("m", 200)]]
    total = sum(c for own in parts for _, c in own)
    one = postings.merged(parts)
    assert sum(c for _, c in one) == total and [t for t, _ in one] == sorted(t for t, _ in one) and len(one) <= 1 + total // 2
    between = postings.bounds(one)
    assert len(between) + 1 == -(-total // 32) and between == sorted(between) and between.count("m") >= 5
    assert sum(c for _, c in postings.merged([one], 0.5)) == round(total / 2) and postings.merged([]) == postings.bounds([]) == []


@pytest.mark.parametrize("n", [0, 1, 300])
def test_parts_of_sorted_terms(n):
    """F3"""
    some = random.Random(n)
    terms = sorted(some.choice("abcé𝒜") * some.randint(0, 3) for _ in range(n))
    for between in ([], ["b"], sorted(some.choices(terms or ["x"], k=9)), ["", "a", "aa", "aa", "aa", "zz"]):
        want = [bisect_left(between, t) + k % (between.count(t) + 1) for k, t in enumerate(terms)]
        assert postings._parts(pa.array(terms, "string"), np.arange(n), between).to_pylist() == want


def test_order_of_numbers():
    """F3"""
    for most in (1, 60_000, 70_000, 2**31 - 1):
        key = np.random.default_rng(most).integers(0, most, 5000).astype("int32")
        assert (postings._order(key) == np.argsort(key, kind="stable")).all()
    assert len(postings._order(np.zeros(0, "int32"))) == 0


def test_runs_of_a_batch_are_sorted():
    batch = pa.RecordBatch.from_pydict({"term": ["b", "c", "c", "a", "b", "a"]})
    assert [b.column("term").to_pylist() for b in postings._sorted(batch)] == [["b", "c", "c"], ["a", "b"], ["a"]] and list(postings._sorted(batch.slice(0, 0))) == []
