import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wordloom.functions.formats import ID, NUMERIC, TEXT, Schema
from wordloom.operators import facets as fc
from wordloom.operators import query as Q
from wordloom.operators.scoring import Frequency
from wordloom.operators.search import NoTermsException
from wordloom.operators.spelling import correct_query
from wordloom.sources.corpus import FrameCorpus

DATA = "/root/testdata/sf0.001"
NAMES = ["and_or_not_matrix", "dismax_score", "phrase_slop", "span_not", "nested_parent", "facet_query", "collapse_by_source", "prefix_scored", "key_terms_bo1", "parsed_plus_minus", "ngram_terms", "results_upgrade"]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, name):
    found = sorted(str(tuple(r[c] for c in sorted(r.asDict()))) for r in __spark_entry__.queries()[name](spark, DATA).collect())
    c = duckdb.connect()
    for t in ("documents", "conversations", "nation"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = c.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in df.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert found == sorted(str(tuple(r[i] for i in order)) for r in df.fetchall()) and found


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


WORDS = ["alfa", "bravo", "charlie", "delta"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 6))), r.choice(["x", "y", None]), r.randrange(9)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, n int").cache()
    return FrameCorpus(df, Schema(text=TEXT(), tag=ID(), n=NUMERIC())), rows


def tree(r, depth):
    if depth == 0 or r.random() < 0.3:
        return Q.Term("text", r.choice(WORDS)) if r.random() < 0.8 else Q.NumericRange("n", r.randrange(5), r.randrange(5, 9))
    kids = [tree(r, depth - 1) for _ in range(2)]
    return r.choice([lambda: Q.And(tuple(kids)), lambda: Q.Or(tuple(kids)), lambda: Q.AndNot(*kids), lambda: Q.AndMaybe(*kids), lambda: Q.Require(*kids), lambda: Q.Not(kids[0]), lambda: Q.DisjunctionMax(tuple(kids))])()


def sets(q, rows):
    every = {x[0] for x in rows}
    if isinstance(q, Q.Term):
        return {x[0] for x in rows if q.text in x[1].split()}
    if isinstance(q, Q.NumericRange):
        return {x[0] for x in rows if q.start <= x[3] <= q.end}
    if isinstance(q, Q.Not):
        return every - sets(q.query, rows)
    if isinstance(q, (Q.Or, Q.DisjunctionMax)):
        return set().union(*(sets(c, rows) for c in q.subs))
    if isinstance(q, Q.And):
        return set.intersection(*(sets(c, rows) for c in q.subs))
    a, b = sets(q.a, rows), sets(q.b, rows)
    return a - b if isinstance(q, Q.AndNot) else a if isinstance(q, Q.AndMaybe) else a & b


def test_random_trees_against_sets(corpus):
    c, rows = corpus
    r = random.Random(5)
    for _ in range(12):
        q = tree(r, 3)
        assert {x.doc_id for x in c.searcher().docs_for_query(q).collect()} == sets(q, rows), q


def test_results(corpus):
    c, rows = corpus
    s = c.searcher(Frequency())
    q = Q.Or((Q.Term("text", "alfa"), Q.Term("text", "bravo")))
    want = sorted(((-(x[1].split().count("alfa") + x[1].split().count("bravo")), x[0]) for x in rows if {"alfa", "bravo"} & set(x[1].split())))
    found = s.search(q, limit=7, terms=True, groupedby="tag")
    assert [(-r.score, r.doc_id) for r in found.rows().orderBy("rank").collect()] == want[:7] and found.total() == len(want)
    assert {tuple(r) for r in found.groups().collect()} == {(t, sum(rows[d][2] == t for _, d in want)) for t in {rows[d][2] for _, d in want}}
    got = {r.doc_id: set(r.matched) for r in found.matched_terms().collect()}
    assert all(got[d] == {f"text:{w}" for w in ("alfa", "bravo") if w in rows[d][1].split()} for d in got)
    with pytest.raises(NoTermsException):
        s.search(q).matched_terms()
    assert [r.doc_id for r in s.search_page(q, 99, 10).rows().orderBy("rank").collect()] == [d for _, d in want[(len(want) - 1) // 10 * 10 :]]
    by_n = s.search(Q.Every(), limit=None, sortedby=[fc.FieldFacet("tag"), fc.FieldFacet("n", reverse=True)]).rows().collect()
    assert [r.doc_id for r in by_n] == [x[0] for x in sorted(rows, key=lambda x: (x[2] is None, x[2] or "", -x[3], x[0]))]
    kept = s.search(Q.Every(), limit=None, collapse="tag", collapse_order="n").rows().collect()
    assert len(kept) == 2 + sum(x[2] is None for x in rows)


def test_empty_corpus_and_unknown_terms(spark, corpus):
    c, _ = corpus
    empty = FrameCorpus(c.docs().limit(0), c.schema)
    for q in (Q.Term("text", "alfa"), Q.Every(), Q.Not(Q.Term("text", "alfa")), Q.Phrase("text", ("alfa", "bravo")), Q.NullQuery()):
        assert empty.searcher().search(q).rows().collect() == []
    assert c.searcher().search(Q.Term("text", "zulu")).rows().collect() == [] and c.searcher().suggest("text", "brvo") == ["bravo"]
    fixed = correct_query(c, Q.And((Q.Term("text", "brvo"), Q.Term("text", "alfa"))), "brvo alfa")
    assert fixed.corrected_text == "bravo alfa" and fixed.format_string("*", "*") == "*bravo* alfa"


def test_normal_forms():
    a, b, n = Q.Term("f", "a"), Q.Term("f", "b"), Q.NullQuery()
    assert Q.And((a, Q.And((b, a)))).normalize() == Q.And((a, b)) and Q.Or((a, n)).normalize() == a and Q.And((a, n)).normalize() == n
    assert Q.Wildcard("f", "ab*").normalize() == Q.Prefix("f", "ab") and Q.TermRange("f", "a", "a").normalize() == a and Q.Or((a,), 2.0).normalize() == Q.Term("f", "a", 2.0)
    assert Q.And((a, Q.Or((b, a)))).requires() == {a} and Q.And((a, b)).all_terms() == {("f", "a"), ("f", "b")} and Q.And((a, b)).replace_text("f", "a", "c").all_terms() == {("f", "c"), ("f", "b")}
    assert Q.Or((Q.NumericRange("n", 1, 5), Q.NumericRange("n", 4, 9))).normalize() == Q.NumericRange("n", 1, 9)


def test_the_plan_reads_postings_once_a_leaf_field(corpus):
    plan = corpus[0].searcher().matches(Q.And((Q.Term("text", "alfa"), Q.Not(Q.Term("text", "bravo")))), scored=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1
    assert F is not None
