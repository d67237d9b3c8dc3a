"""Postings in blocks: what an index writes, folds and reads back, held against plain ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.functions import analysis as an
from wordloom.functions import words
from wordloom.functions.formats import ID, TEXT, Schema
from wordloom.sources import index as index_module
from wordloom.sources import postings
from wordloom.sources.corpus import FrameCorpus
from wordloom.sources.index import create_in

ODD = ["Alfa bravo.charlie .x y. a..b the.of", "", None, ".", "a.", "...", ".é", "é.ß 日本.語 x", "İstanbul ΣΑΣ", "1.5 a_b", "a b́c 🎉x𝒜.𝒜", "the of alfa the", "a.b", "c", "alfa alfa the bravo alfa"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k * 7 - 3, t, "abc"[k % 3]) for k, t in enumerate(ODD)], "doc_id long, text string, lang string")


def rows(df):
    return sorted((r.term, r.doc_id, r.tf, r.weight, r.length, *(getattr(r, "positions", ()) or ())) for r in df.collect())


@pytest.mark.parametrize("a", [an.StandardAnalyzer(), an.SimpleAnalyzer(), an.StandardAnalyzer(minsize=1, maxsize=3, stoplist=["x"])])
def test_words_cut_from_bytes(spark, docs, a):
    """F2, F3, F7"""
    (stop,), ranges = a.plain(), words.letters(spark)
    got = docs.select(F.lower("text").alias("low"), a.tokens(F.col("text")).alias("t"), words.size(F.col("text"), ranges, stop).alias("n")).collect()
    terms, codes, sizes, first = words.coded(pa.array([None, *(r.low for r in got)])[1:], ranges, stop)
    assert [r.n for r in got] == sizes.tolist() == [len(r.t) for r in got]
    named = np.array(terms.to_pylist(), object)[codes].tolist()
    for r, f, to in zip(got, first.tolist(), np.cumsum(sizes).tolist()):
        assert [(x.t, x.pos) for x in r.t] == [(w, f + k) for k, w in enumerate(named[to - len(r.t) : to])]


def test_other_analyzers_are_not_cut():
    assert (an.RegexTokenizer() | an.StopFilter()).plain() is None and an.SimpleAnalyzer(r"[a-z]+").plain() is None and an.IDAnalyzer().plain() is None
    assert (an.SimpleAnalyzer() | an.StopFilter(renumber=False)).plain() is None and (an.StandardAnalyzer() | an.ReverseTextFilter()).plain() is None


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_blocks_are_written_folded_and_read(spark, docs, tmp_path, monkeypatch, most):
    """F2, F4, F5, F6"""
    monkeypatch.setattr(index_module, "SENT_DELETIONS", most)
    schema = Schema(text=TEXT(stored=True, field_boost=2.0), lang=ID(stored=True))
    ix = create_in(spark, str(tmp_path / "ix"), schema)
    for k in ("lang = 'a'", "lang <> 'a'"):
        w = ix.writer()
        w.add_documents(docs.where(k))
        w.commit()
    for s in ix.manifest.segments:
        assert "doc_ids" in spark.read.parquet(f"{ix.path}/{s}/postings_text").columns
    assert rows(ix.postings("text", positions=True)) == rows(FrameCorpus(docs, schema).postings("text", positions=True))
    ix.delete_document(4)
    ix.delete_by_term("text", "bravo")
    live = FrameCorpus(docs.join(ix.docs().select("doc_id"), "doc_id", "left_semi"), schema)
    want = rows(live.postings("text", positions=True)), sorted(map(tuple, live.lengths("text").collect()))
    for _ in range(2):
        assert (rows(ix.postings("text", positions=True)), sorted(map(tuple, ix.lengths("text").collect()))) == want and ix.docs().count() == 13
        ix.optimize()
    table = spark.read.parquet(f"{ix.path}/{ix.manifest.segments[0]}/postings_text")
    assert table.count() == table.select("term").distinct().count() < len(want[0])


def test_rows_of_older_indexes_are_read(spark, docs, tmp_path):
    schema = Schema(text=TEXT())
    ix = create_in(spark, str(tmp_path / "ix"), schema)
    w = ix.writer()
    w.add_documents(docs.select("doc_id", "text"))
    w.commit()
    want = rows(ix.postings("text", positions=True))
    old = f"{ix.path}/{ix.manifest.segments[0]}/postings_text"
    plain = ix.postings("text", positions=True).drop("field").localCheckpoint()
    plain.write.mode("overwrite").parquet(old)
    assert rows(ix.postings("text", positions=True)) == want
    ix.optimize()
    assert rows(ix.postings("text", positions=True)) == want and "doc_ids" in spark.read.parquet(f"{ix.path}/{ix.manifest.segments[0]}/postings_text").columns


def test_a_term_of_many_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(postings, "AT_ONCE", 3)
    monkeypatch.setattr(postings, "PART_ROWS", 2)
    monkeypatch.setattr(postings, "BLOCK_ROWS", 2)
    kind = TEXT()
    between = postings.bounds_of(docs, "text", kind)
    blocks = postings.joined(postings.dealt(postings.blocks(docs, "text", kind, between), between).sortWithinPartitions("term"))
    assert rows(postings.opened(blocks, True)) == rows(FrameCorpus(docs, Schema(text=kind)).postings("text", positions=True))


def test_scored_terms_are_cut_from_bytes(spark, docs, monkeypatch):
    """F15"""
    corpus = FrameCorpus(docs, Schema(text=TEXT()))
    want = rows(corpus.postings("text", lambda t: t.isin("alfa", "bravo"))), corpus.field_stats(["text"]).first()
    monkeypatch.setattr(an.RegexTokenizer, "split", None)  # the regular expression isn't asked
    p, stats = corpus.matched("text", lambda t: t.isin("alfa", "bravo"))
    assert (rows(p), stats.first()) == want
