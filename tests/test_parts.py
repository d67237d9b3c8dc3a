import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions.formats import ID, NUMERIC, TEXT, Schema, SchemaClass, ensure_schema, wrapped
from wordloom.functions.text import lfu_cache, tiered_ranges, try_for
from wordloom.functions.wordnet import Thesaurus
from wordloom.operators import classify
from wordloom.operators import query as Q
from wordloom.operators import spans
from wordloom.operators.highlight import EventFormatter, Highlighter, PinpointFragmenter, UppercaseFormatter, offsets
from wordloom.operators.scoring import BM25F, DebugModel
from wordloom.operators.spelling import list_suggestions, multi_suggestions
from wordloom.plans import dategrammar as dg
from wordloom.plans import parser as ps
from wordloom.sources.corpus import FrameCorpus

TEXTS = [(1, "alfa bravo charlie"), (2, "bravo bravo delta"), (3, "charlie echo alfa"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def corpus(spark):
    return FrameCorpus(spark.createDataFrame(TEXTS, "doc_id long, text string"), Schema(text=TEXT()))


def T(x):
    return Q.Term("text", x)


def known(words):
    return lambda w: w.lower() if w.lower() in words else None


def test_pinpoint_fragments():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    h = Highlighter(PinpointFragmenter(maxchars=40, surround=10), UppercaseFormatter(), top=5)
    assert h.excerpt(text, known({"four", "five", "fourteen"})) == "two three FOUR FIVE six seven...thirteen FOURTEEN fifteen"
    r = random.Random(1)
    for _ in range(200):
        t = " ".join(r.choice(["ab", "cdef", "g", "hijklm"]) for _ in range(r.randrange(1, 40)))
        m = Highlighter().matches(t, known({"g", "hijklm"}))
        got = PinpointFragmenter(r.randrange(20, 60), r.randrange(0, 12)).fragments(t, m)
        assert [x for f in got for x in f.matches] == m and all(f.start <= f.matches[0][0] and f.matches[-1][1] <= f.end for f in got)
        assert all(a.end <= b.start for a, b in zip(got, got[1:]))


def test_events_and_offsets(spark):
    ev = Highlighter(formatter=EventFormatter()).excerpt("see alfa now", known({"alfa"}))
    assert ev == [("TEXT", "see "), ("START", ("strong", "match")), ("TEXT", "alfa"), ("END", "strong"), ("TEXT", " now")]
    row = spark.createDataFrame([("Día  x.y, Z", )], "t string").select(offsets(F.col("t")).alias("o")).first()
    assert [tuple(x) for x in row.o] == [("día", 0, 0, 3), ("x.y", 1, 5, 8), ("z", 2, 10, 11)]


def test_query_helpers(corpus):
    q = Q.Or((T("alfa"), T("nosuch"), Q.And((T("bravo"), T("delta")))))
    assert q.existing_terms(corpus) == {("text", "alfa"), ("text", "bravo"), ("text", "delta")}
    assert q.simplify(corpus).all_terms() == q.existing_terms(corpus)
    assert T("bravo").estimate_size(corpus) == 2 and Q.And((T("bravo"), T("delta"))).estimate_size(corpus) == 1 and q.estimate_size(corpus) == 3
    for x in (q, T("alfa"), Q.AndNot(T("bravo"), T("delta")), Q.Every()):
        assert corpus.searcher().matches(x).count() <= x.estimate_size(corpus)
    assert Q.error_query("bad").error == "bad" and Q.error_query("bad", T("a")) == T("a")


def test_reader_statistics(corpus):
    assert corpus.first_id("text", "charlie") == 1 and corpus.first_id("text", "nosuch") is None and corpus.doc_count_all() == 5 and not corpus.has_deletions()
    assert corpus.frequency("text", "bravo") == 3 and corpus.doc_frequency("text", "bravo") == 2 and corpus.doc_frequency("text", "x") == 0
    assert corpus.has_vector(1, "text") and not corpus.has_vector(5, "text")
    assert {tuple(r) for r in corpus.vector_as("frequency", 2, "text").collect()} == {("bravo", 2), ("delta", 1)}
    assert (corpus.min_field_length("text"), corpus.max_field_length("text"), corpus.doc_field_length(4, "text"), corpus.doc_field_length(1, "text")) == (3, 3, 0, 3)


def test_searcher_helpers(corpus):
    s = corpus.searcher()
    assert [r.doc_id for r in s.collector(limit=1)(T("bravo")).rows().collect()] == [2]
    assert s.search_with_collector(T("alfa"), lambda hits: hits.agg(F.count("doc_id").alias("n"))).first().n == 2
    assert {r.score for r in s.boolean_context().matches(T("bravo")).collect()} == {1.0}
    plain = {r.doc_id: r.score for r in s.matches(T("bravo")).collect()}
    assert {r.doc_id: r.score for r in s.context(DebugModel(BM25F())).matches(T("bravo")).collect()} == plain
    every = s.search(Q.Every(), limit=None)
    assert [r["rank"] for r in every.rows().collect()] == [None] * 5
    got = sorted((r["rank"], r.doc_id) for r in every.ranked().collect())
    assert got == [(i, i) for i in range(1, 6)]
    many = FrameCorpus(corpus.spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 3001).alias("v")).repartition(7), Schema(v=NUMERIC()))
    ranked = many.searcher().search(Q.Every(), limit=None, sortedby="v").ranked().orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 3001)) and [r.doc_id for r in ranked] == sorted(range(3000), key=lambda i: i * 7919 % 3001)
    page = many.searcher().search_page(Q.Every(), 2, 10, sortedby="v")
    assert [r.doc_id for r in page.rows().orderBy("rank").collect()] == sorted(range(3000), key=lambda i: i * 7919 % 3001)[10:20]


def test_schemas():
    class Base(SchemaClass):
        title = TEXT(stored=True)

    class Mail(Base):
        sent_ = NUMERIC()

    assert ensure_schema(Mail).names() == ["title", "sent"] and ensure_schema(Mail.schema()).names() == ["title", "sent"]
    with pytest.raises(TypeError):
        ensure_schema(3)
    assert wrapped(ID(), stored=True).stored and not ID().stored


def test_thesaurus(spark, tmp_path, corpus):
    (tmp_path / "wn_s.pl").write_text("s(1,1,'Alfa',n,1,0).\ns(1,2,'first letter',n,1,0).\ns(2,1,'bravo',n,1,0).\ns(2,2,'delta',v,1,0).\ns(2,3,'o''clock',v,1,0).\ng(1,'x').\n\n")
    t = Thesaurus.from_file(spark, str(tmp_path / "wn_s.pl")).saved()
    assert t.synonyms("bravo") == ["delta", "o'clock"] and t.synonyms("ALFA") == ["first letter"] and t.synonyms("x") == []
    assert {tuple(r) for r in t.pairs().where("word = 'alfa'").collect()} == {("alfa", "first letter")}
    found = {r.doc_id for r in corpus.searcher().docs_for_query(t.expand(T("delta"))).collect()}
    assert found == {1, 2}


def test_parser_parts():
    p = ps.QueryParser("text", None).add_tagger(ps.regex_tagger(r"#(\d+)", lambda m: Q.Term("id", m[1])))
    assert p.parse("a #12") == Q.And((Q.Term("text", "a"), Q.Term("id", "12")))

    def fails(m):
        raise ps.QueryParserError("no")

    bad = ps.QueryParser("text", None).add_tagger(ps.regex_tagger("!!", fails)).parse("!!")
    assert isinstance(bad, Q.NullQuery) and bad.error == "no"
    up = ps.QueryParser("text", None).add_filter(lambda nodes: [x for x in nodes if x.text != "noise"])
    assert up.parse("noise a") == Q.Term("text", "a") and [x.text for x in up.process("noise a")] == ["a"]
    mark = ps.regex_tagger(r"~~", lambda m: ps.Node("mark"))
    twice = lambda x: ps.Node("query", query=Q.Term("text", x.text, 2.0))
    pre = ps.QueryParser("text", None).add_tagger(mark).add_filter(ps.rewrite_prefix("mark", twice))
    post = ps.QueryParser("text", None).add_tagger(mark).add_filter(ps.rewrite_postfix("mark", twice))
    assert pre.parse("~~a b") == Q.And((Q.Term("text", "a", 2.0), Q.Term("text", "b"))) and post.parse("a ~~ b") == Q.And((Q.Term("text", "a", 2.0), Q.Term("text", "b")))


def test_date_grammar():
    base = dt.datetime(2010, 9, 20, 15, 16, 6)
    month = dg.Words("month", {"jan": 1, "january": 1, "feb": 2, "sept": 9})
    day, year = dg.Regex(r"(?P<day>[0123]?\d)(?!\d)(st|nd|rd|th)?"), dg.Regex(r"(?P<year>[12]\d{3})(?!\d)")
    time = dg.Regex(r"(?P<hour>\d{1,2}):(?P<minute>\d{2})")
    span = lambda e, t: (lambda r: None if r is None else (r[0].isoformat()[:16], r[1].isoformat()[:16]))(e.read(t, base))
    date = dg.Bag([time, month, day, year], requires=(1,))
    assert span(date, "12 january 2009") == ("2009-01-12T00:00", "2009-01-12T23:59") == span(date, "jan, 2009 12th")
    assert span(date, "feb") == ("2010-02-01T00:00", "2010-02-28T23:59") and span(date, "sept 12 5:30") == ("2010-09-12T05:30", "2010-09-12T05:30") and span(date, "2009") is None
    assert span(dg.Sequence([month, dg.Optional(day), year]), "jan 2009") == ("2009-01-01T00:00", "2009-01-31T23:59") and span(dg.Sequence([month, day]), "jan x") is None
    assert span(dg.Choice([year, month]), "feb") == span(date, "feb") and span(dg.Combo(date, date), "jan 3 2009 to feb 2009") == ("2009-01-03T00:00", "2009-02-28T23:59")
    assert dg.ToEnd(month).parse("feb x", 0, base, {}) is None and dg.Spoken().read("tomorrow", base)[0] == dt.datetime(2010, 9, 21) and span(date, "feb 31") is None
    assert dg.weekday(base, 0) == base and dg.weekday(base, 2) == base + dt.timedelta(days=2) and dg.weekday(base, 6, -1) == base - dt.timedelta(days=1) and dg.weekday(base, 0, 2) == base + dt.timedelta(days=7)


def test_small_tools(spark):
    for low, high in ((0, 255), (3, 1000), (17, 17), (5, 4096), (0, 2**40 - 3)):
        for step in (0, 1, 4):
            ranges = tiered_ranges(low, high, 48, step)
            edges = sorted((a << s, ((b + 1) << s) - 1) for s, a, b in ranges)
            assert edges[0][0] == low and edges[-1][1] == high and all(x[1] + 1 == y[0] for x, y in zip(edges, edges[1:]))
    calls = []
    f = lfu_cache(2)(lambda x: calls.append(x) or x * 2)
    assert [f(1), f(1), f(2), f(3), f(1), f(2)] == [2, 2, 4, 6, 2, 4] and calls == [1, 2, 3, 2]
    assert try_for(lambda: True) and not try_for(lambda: False, 0.05, 0.01)
    assert spans.before_place([(1, 2), (3, 4), (7, 9)], 4) == 2
    words = spark.createDataFrame([("alfa",), ("alto",), ("bravo",)], "term string")
    got = multi_suggestions([(list_suggestions(words, "alfo"), 1.0), (list_suggestions(words, "alto"), 3.0)]).collect()
    assert [(r.term, r.distance) for r in got] == [("alto", 0.0), ("alfa", 1.0)]


def plain_kmeans(values, c, t, rounds):
    for _ in range(rounds):
        at = [min(range(len(c)), key=lambda i: (abs(v - c[i]), i)) for v in values]
        new = [sum(own) / len(own) if (own := [v for v, k in zip(values, at) if k == i]) else c[i] for i in range(len(c))]
        moved, c = max(abs(a - b) for a, b in zip(c, new)), new
        if moved <= t:
            break
    return [min(range(len(c)), key=lambda i: (abs(v - c[i]), i)) for v in values]


def test_kmeans_and_windows_match_plain_ones(spark):
    r = random.Random(5)
    values = [r.gauss(m, 2.0) for m in (0, 10, 30) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    got = {x.i: x.cluster for x in classify.kmeans(df, "v", 3, centers=[5.0, 6.0, 7.0]).collect()}
    assert [got[i] for i in range(len(values))] == plain_kmeans(values, [5.0, 6.0, 7.0], 1e-4, 50)
    whole = [r.randrange(-40, 40) for _ in range(200)]
    rows = classify.swin(spark.createDataFrame([(x,) for x in whole], "v int"), "v", 7).collect()
    assert sorted(map(tuple, rows)) == sorted((x, max(y for y in whole if x <= y <= x + 7), sum(x <= y <= x + 7 for y in whole)) for x in set(whole))


def test_simhash_matches_plain_counting(spark):
    import hashlib

    words = ["alfa", "bravo", "charlie", "bravo", "delta"]
    w = [1.0, 2.0, 0.5, 1.0, 3.0]
    h = [int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in words]
    want = sum(1 << i for i in range(64) if sum(b if a >> i & 1 else -b for a, b in zip(h, w)) > 0)
    row = spark.createDataFrame([(words, w), ([], [])], "x array<string>, w array<double>").select(classify.simhash(F.col("x"), F.col("w"), classify.md5_hash).alias("h")).collect()
    assert row[0].h % 2**64 == want and row[1].h == 0
