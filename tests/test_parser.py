import datetime as dt

import pytest

from wordloom.functions.formats import BOOLEAN, DATETIME, ID, NGRAM, NUMERIC, TEXT, Schema
from wordloom.operators import query as Q
from wordloom.plans.dates import DateParser, add_months, datetime_to_long, long_to_datetime, relative_days
from wordloom.plans.parser import ALL, DisMaxParser, MultifieldParser, QueryParser, SimpleParser

S = Schema(text=TEXT(), title=TEXT(), path=ID(), n=NUMERIC(), f=NUMERIC(float), day=DATETIME(), ok=BOOLEAN(), g=NGRAM(2, 3))
BASE = dt.datetime(2010, 9, 20, 15, 16, 6)
t = lambda x, b=1.0, f="text": Q.Term(f, x, b)


@pytest.fixture(scope="module")
def p(spark):
    return QueryParser("text", S, spark, ALL, dates=DateParser(BASE))


CASES = [
    ("alfa bravo", Q.And((t("alfa"), t("bravo")))), ("Alfa OR bravo", Q.Or((t("alfa"), t("bravo")))), ("a1 AND b1 OR c1", Q.Or((Q.And((t("a1"), t("b1"))), t("c1")))), ("alfa NOT bravo", Q.And((t("alfa"), Q.Not(t("bravo"))))),
    ("alfa ANDNOT bravo", Q.AndNot(t("alfa"), t("bravo"))), ("alfa ANDMAYBE bravo", Q.AndMaybe(t("alfa"), t("bravo"))), ("alfa REQUIRE bravo", Q.Require(t("alfa"), t("bravo"))),
    ("(alfa OR bravo) charlie", Q.And((Q.Or((t("alfa"), t("bravo"))), t("charlie")))), ("title:alfa bravo", Q.And((t("alfa", f="title"), t("bravo")))), ("title:(alfa bravo)", Q.And((t("alfa", f="title"), t("bravo", f="title")))),
    ("alfa^2.5", t("alfa", 2.5)), ("(alfa bravo)^3", Q.And((t("alfa"), t("bravo")), 3.0)), ("alf*", Q.Prefix("text", "alf")), ("a?f*a", Q.Wildcard("text", "a?f*a")), ('r"al.a"', Q.Regex("text", "al.a")), ("alfa~2/1", Q.FuzzyTerm("text", "alfa", maxdist=2, prefixlength=1)),
    ("*:*", Q.Every()), ("title:*", Q.Every("title")), ("path:[a TO f}", Q.TermRange("path", "a", "f", False, True)), ("path:[a TO]", Q.TermRange("path", "a", None)), ("n:[10 TO 20]", Q.NumericRange("n", 10, 20)), ("n:>10", Q.NumericRange("n", 10, None, True)), ("f:<=2.5", Q.NumericRange("f", None, 2.5)), ("n:7", Q.NumericRange("n", 7, 7)),
    ("ok:yes", Q.ColumnQuery("ok", True)), ("+alfa -bravo charlie", Q.AndNot(Q.AndMaybe(t("alfa"), t("charlie")), t("bravo"))), ("path:'a b c'", t("a b c", f="path")), ("the", Q.NullQuery()), ("alfa AND", t("alfa")), ("(alfa", t("alfa")), ("", Q.NullQuery()), ("nofield:alfa", None),
    ("g:abcd", Q.And((t("abc", f="g"), t("bcd", f="g")))), ("day:2005", Q.DateRange("day", dt.datetime(2005, 1, 1), dt.datetime(2005, 12, 31, 23, 59, 59, 999999))), ('"alfa (bravo OR charlie)"', Q.SpanNear((t("alfa"), Q.Or((t("bravo"), t("charlie")))))),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0] for c in CASES])
def test_strings(p, text, want):
    got = p.parse(text)
    assert got == want if want is not None else isinstance(got, Q.Query)


def test_phrases(spark):
    p = QueryParser("text", S, spark)
    assert p.parse('"alfa the bravo"~3') == Q.Phrase("text", ("alfa", "bravo"), 3)
    assert p.parse('"alfa"') == t("alfa")


def test_other_parsers(spark):
    m = MultifieldParser(["text", "title"], S, spark, {"title": 2.0})
    assert m.parse("alfa bravo") == Q.And((Q.Or((t("alfa"), t("alfa", 2.0, "title"))), Q.Or((t("bravo"), t("bravo", 2.0, "title")))))
    assert SimpleParser("text", S, spark).parse("alfa AND bravo -charlie") == Q.AndNot(Q.Or((t("alfa"), t("bravo"))), t("charlie"))
    assert DisMaxParser({"text": 1.0, "title": 3.0}, S, spark, 0.1).parse("alfa") == Q.DisjunctionMax((t("alfa"), t("alfa", 3.0, "title")), tiebreak=0.1)
    q = QueryParser("text", S, spark, aliases={"body": "text"}, copies={"title": "path"}, pseudo={"rev": lambda q: Q.Not(q)})
    assert q.parse("body:alfa") == t("alfa") and q.parse("title:x9") == Q.Or((t("x9", f="title"), t("x9", f="path"))) and q.parse("rev:alfa") == Q.Not(t("alfa"))


DATES = {
    "tomorrow": ((2010, 9, 21), (2010, 9, 21, 23, 59, 59, 999999)), "next tuesday": ((2010, 9, 21), (2010, 9, 21, 23, 59, 59, 999999)), "last monday": ((2010, 9, 13), (2010, 9, 13, 23, 59, 59, 999999)), "-2 weeks": ((2010, 9, 6, 15, 16, 6), (2010, 9, 6, 15, 16, 6)), "5 mins ago": ((2010, 9, 20, 15, 11, 6), (2010, 9, 20, 15, 11, 6)),
    "jan 12 2009": ((2009, 1, 12), (2009, 1, 12, 23, 59, 59, 999999)), "12th of january": ((2010, 1, 12), (2010, 1, 12, 23, 59, 59, 999999)), "feb 2008": ((2008, 2, 1), (2008, 2, 29, 23, 59, 59, 999999)), "20050315": ((2005, 3, 15), (2005, 3, 15, 23, 59, 59, 999999)), "5:10pm": ((2010, 9, 20, 17, 10), (2010, 9, 20, 17, 10, 59, 999999)),
    "march 3 2011 at 10am": ((2011, 3, 3, 10), (2011, 3, 3, 10, 59, 59, 999999)), "jan 2 to feb 3 2011": ((2011, 1, 2), (2011, 2, 3, 23, 59, 59, 999999)), "last year": ((2009, 1, 1), (2009, 12, 31, 23, 59, 59, 999999)),
}


@pytest.mark.parametrize("text", DATES)
def test_dates(text):
    a, b = DATES[text]
    assert DateParser(BASE).parse(text) == (dt.datetime(*a), dt.datetime(*b))


def test_date_parts():
    assert DateParser(BASE).parse("no date") is None and DateParser(BASE).parse("feb 31") is None
    assert relative_days(0, 0, 1) == 7 and relative_days(0, 6, -1) == -1 and add_months(dt.datetime(2024, 1, 31), 1) == dt.datetime(2024, 2, 29)
    assert long_to_datetime(datetime_to_long(BASE)) == BASE
