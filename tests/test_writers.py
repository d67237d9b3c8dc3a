import pytest
from pyspark.sql import functions as F

from wordloom.functions.formats import ID, NUMERIC, TEXT, Schema
from wordloom.operators import query as Q
from wordloom.sources.corpus import FrameCorpus
from wordloom.sources.index import BufferedWriter, EmptyIndexError, QueuedWriter, Together, add_sortable, add_spelling, copy_to, create_in, exists, open_dir, version_in


def schema():
    return Schema(path=ID(unique=True), text=TEXT(), size=NUMERIC())


def rows(spark, *items):
    return spark.createDataFrame(list(items), "doc_id long, path string, text string, size int")


def ids(ix, q=None):
    return sorted(r.doc_id for r in ix.searcher().docs_for_query(q or Q.Every()).collect())


@pytest.fixture
def ix(spark, tmp_path):
    return create_in(spark, str(tmp_path / "ix"), schema())


def test_queue_waits_for_others(spark, ix):
    queue = QueuedWriter(ix, wait=0.01)
    queue.add_documents(rows(spark, (1, "a", "alfa", 1)))
    other = ix.writer()
    other.add_documents(rows(spark, (2, "b", "bravo", 2)))
    other.commit()
    queue.commit()
    assert ids(ix.refresh()) == [1, 2]
    queue.delete_by_term("text", "bravo")
    queue.cancel()
    queue.commit()
    assert ids(ix.refresh()) == [1, 2]
    with pytest.raises(AttributeError):
        queue.nonsense()


def test_buffer_merge_columns_and_copies(spark, ix, tmp_path):
    with BufferedWriter(ix, limit=2, period=None) as w:
        for k in range(3):
            w.add_documents(rows(spark, (k, f"p{k}", f"alfa w{k}", k)))
        assert len(w.queue) == 1 and sorted(r.doc_id for r in w.searcher().docs_for_query(Q.Term("text", "alfa")).collect()) == [0, 1, 2]
        w.update_documents(rows(spark, (7, "p1", "renewed", 9)))
    ix = ix.refresh()
    assert ids(ix) == [0, 2, 7] and ix.doc_count_all() == 4 and ix.has_deletions() and ix.is_deleted(1) and not ix.is_deleted(0) and not ix.is_deleted(99)
    w = ix.writer()
    w.add_reader(FrameCorpus(rows(spark, (9, "p9", "alfa omega", 3)), schema()))
    w.commit(merge_below=1000, fan=3)
    ix = ix.refresh()
    assert len(ix.manifest.segments) == 1 and ids(ix) == [0, 2, 7, 9] and ids(ix, Q.Term("text", "alfa")) == [0, 2, 9]
    add_sortable(ix, "twice", F.col("size") * 2)
    add_spelling(ix.refresh(), ["text"])
    ix = ix.refresh()
    assert [r.doc_id for r in ix.searcher().search(Q.Every(), sortedby="twice").rows().collect()] == [0, 2, 9, 7]
    ix.delete_document(0)
    to = str(tmp_path / "copy")
    copy_to(spark, ix.path, to)
    assert ids(open_dir(spark, to, schema())) == [2, 7, 9] == ids(ix.refresh().to_frame())
    assert exists(spark, to) and not exists(spark, to, 1) and version_in(spark, to)[1] == version_in(spark, ix.path)[1]
    with pytest.raises(EmptyIndexError):
        version_in(spark, str(tmp_path / "none"))


def test_corpora_together(spark):
    a = FrameCorpus(rows(spark, (1, "a", "alfa bravo", 1), (2, "b", "alfa", 2)), schema())
    b = FrameCorpus(rows(spark, (2, "c", "bravo bravo", 5), (3, "d", "delta", 6)), schema())
    both = FrameCorpus(rows(spark, (1, "a", "alfa bravo", 1), (2, "c", "bravo bravo", 5), (3, "d", "delta", 6)), schema())
    laid = Together([a, b], overlay=True)
    for q in (Q.Term("text", "alfa"), Q.Term("text", "bravo"), Q.Not(Q.Term("text", "alfa")), Q.NumericRange("size", 5, 6)):
        got = {r.doc_id: round(r.score, 9) for r in laid.searcher().matches(q).collect()}
        assert got == {r.doc_id: round(r.score, 9) for r in both.searcher().matches(q).collect()}
    assert Together([a, b]).docs().count() == 4
