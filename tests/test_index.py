import pytest
from pyspark.sql import functions as F

from wordloom.functions.formats import ID, NUMERIC, TEXT, Schema
from wordloom.operators import query as Q
from wordloom.sources.corpus import FrameCorpus
from wordloom.sources.index import EmptyIndexError, OutOfDateError, create_in, exists_in, open_dir
from wordloom.streaming.ingest import stream_into

ROWS = [(1, "a", "alfa bravo charlie", 3), (2, "b", "bravo bravo delta", 1), (3, "c", "charlie echo the alfa", 2), (4, "d", None, None)]


def schema():
    return Schema(path=ID(unique=True, stored=True), text=TEXT(stored=True), size=NUMERIC())


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, path string, text string, size int")


def found(ix, q):
    return {r.doc_id: round(r.score, 6) for r in ix.searcher().matches(q).collect()}


QUERIES = [Q.Term("text", "bravo"), Q.Or((Q.Term("text", "alfa"), Q.Term("text", "delta"))), Q.Phrase("text", ("alfa", "bravo")), Q.Prefix("text", "ch", constantscore=False), Q.Not(Q.Term("text", "alfa")), Q.NumericRange("size", 2, 3), Q.Every("text"), Q.Term("path", "b")]


@pytest.fixture
def ix(spark, tmp_path):
    ix = create_in(spark, str(tmp_path / "ix"), schema())
    w = ix.writer()
    w.add_documents(frame(spark))
    w.commit()
    return ix


def test_same_results_as_the_frame(spark, ix):
    f = FrameCorpus(frame(spark), schema())
    for q in QUERIES:
        assert found(ix, q) == found(f, q), q
    assert {tuple(r) for r in ix.lexicon("text").collect()} == {tuple(r) for r in f.lexicon("text").collect()}


def test_update_delete_optimize(spark, ix):
    w = ix.writer()
    w.update_documents(frame(spark, [(9, "b", "foxtrot bravo", 7)]))
    w.commit()
    assert set(found(ix, Q.Term("text", "bravo"))) == {1, 9}
    ix.delete_by_term("text", "alfa")
    live = frame(spark, [ROWS[3], (9, "b", "foxtrot bravo", 7)])
    for _ in range(2):
        for q in QUERIES:
            assert found(ix, q) == found(FrameCorpus(live, schema()), q), q
        ix.optimize()
    assert len(ix.manifest.segments) == 1 and not ix.manifest.deletions
    assert ix.vacuum() and found(ix.refresh(), Q.Every()) == {4: 1.0, 9: 1.0}


def test_generations(spark, ix, tmp_path):
    other = open_dir(spark, ix.path, schema())
    late = other.writer()
    late.add_documents(frame(spark, [(7, "g", "golf", 1)]))
    w = ix.writer()
    w.add_documents(frame(spark, [(8, "h", "hotel", 1)]))
    w.commit()
    assert not other.up_to_date() and ix.up_to_date()
    with pytest.raises(OutOfDateError):
        late.commit()
    assert other.refresh().doc_count() == 5
    cancelled = ix.writer()
    cancelled.add_documents(frame(spark, [(7, "g", "golf", 1)]))
    cancelled.cancel()
    cancelled.commit(clear=True)
    assert ix.doc_count() == 0 and found(ix, Q.Term("text", "bravo")) == {}
    assert not exists_in(spark, str(tmp_path / "none"))
    with pytest.raises(EmptyIndexError):
        open_dir(spark, str(tmp_path / "none"), schema())


def test_stream(spark, tmp_path):
    ix = create_in(spark, str(tmp_path / "ix"), schema())
    frame(spark, ROWS[:2]).coalesce(1).write.parquet(str(tmp_path / "in"))
    frame(spark, [(2, "b", "replaced", 5)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, path string, text string, size int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_into(ix, s, str(tmp_path / "state"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert ix.refresh().docs().select(F.count("*")).first()[0] == 2
