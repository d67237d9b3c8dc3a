"""What keeps the writing of an index in proportion to its input."""

import inspect

import pytest

from wordloom.functions import analysis as an
from wordloom.functions.formats import ID, TEXT, Schema
from wordloom.operators import query as Q
from wordloom.sources import postings
from wordloom.sources.corpus import FrameCorpus
from wordloom.sources.index import create_in

TEXTS = ["the alfa bravo alfa", "bravo charlie the bravo delta", None, "", "echo.2 ALFA the of", "the", "alfa alfa alfa", "zulu"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k - 3, t, "ab"[k % 2]) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string")


def rows(df):
    return sorted((r.term, r.doc_id, r.tf, r.weight, r.length, *(r.positions or ())) for r in df.collect())


@pytest.mark.parametrize("kind", [TEXT(field_boost=2.0), TEXT(an.RegexTokenizer(r"[^ ]+") | an.LowercaseFilter() | an.StopFilter(("the",), renumber=False)), TEXT(an.RegexTokenizer(r"[^ ]+") | an.LowercaseFilter())])
def test_postings_by_ranges(spark, docs, kind, monkeypatch):
    monkeypatch.setattr(postings, "PART_ROWS", 2)
    monkeypatch.setattr(postings, "AT_ONCE", 4)
    parted = postings.by_ranges(docs, "text", kind)
    assert "alfa" in (b := postings.bounds_of(docs, "text", kind)) and parted.rdd.getNumPartitions() == len(b) + 1 > 3
    assert rows(parted) == rows(FrameCorpus(docs, Schema(text=kind)).postings("text", positions=True))


def test_fold_takes_postings_over(spark, docs, tmp_path, monkeypatch):
    ix = create_in(spark, str(tmp_path / "ix"), Schema(text=TEXT(stored=True), lang=ID(stored=True)))
    for k in ("a", "b"):
        w = ix.writer()
        w.add_documents(docs.where(f"lang = '{k}'"))
        w.commit()
    ix.delete_by_query(Q.Term("text", "charlie"))
    before = rows(ix.postings("text", positions=True)), sorted(map(tuple, ix.lengths("text").collect()))

    def never(*_):
        raise AssertionError("analysed again")

    for name in ("tokens", "strings", "numbered", "size"):
        monkeypatch.setattr(an.Analyzer, name, never)
    ix.optimize()
    assert len(ix.manifest.segments) == 1 and (rows(ix.postings("text", positions=True)), sorted(map(tuple, ix.lengths("text").collect()))) == before


def test_streamed_source_is_not_one_file():
    from wordloom.plans import catalog_index

    assert "coalesce(1)" not in inspect.getsource(catalog_index._streamed)
