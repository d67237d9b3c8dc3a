"""Queries of search: terms, boolean trees, expansions, ranges, places, parents and children, sorting and grouping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.formats import DATETIME, ID, KEYWORD, NUMERIC, TEXT, Schema
from wordloom.operators import facets as fc
from wordloom.operators import query as Q
from wordloom.operators.scoring import BM25F, PL2, TF_IDF, DFree, Frequency, FunctionWeighting, MultiWeighting, ReverseWeighting
from wordloom.plans.catalog import BM25, TOK, register, tokens_sql
from wordloom.sources.corpus import FrameCorpus, spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> FrameCorpus:
    return FrameCorpus(spread(table(spark, d, "documents")), Schema(text=TEXT(stored=True), lang=ID(stored=True, sortable=True), source=ID(stored=True, sortable=True), n_chars=NUMERIC()))


def orders(spark: SparkSession, d: str) -> FrameCorpus:
    return FrameCorpus(table(spark, d, "orders"), Schema(o_orderstatus=ID(), o_orderpriority=KEYWORD(), o_totalprice=NUMERIC(float), o_orderdate=DATETIME(), o_custkey=NUMERIC()), "o_orderkey")


def parts(spark: SparkSession, d: str) -> FrameCorpus:
    return FrameCorpus(table(spark, d, "part"), Schema(p_name=TEXT(), p_brand=ID(), p_type=KEYWORD(scorable=True), p_size=NUMERIC(), p_retailprice=NUMERIC(float)), "p_partkey")


def T(x: str, boost: float = 1.0) -> Q.Term:
    return Q.Term("text", x, boost)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def top(spark: SparkSession, d: str, q: Q.Query, weighting=None, limit: int = 10) -> DataFrame:
    return rounded(documents(spark, d).searcher(weighting).search(q, limit=limit).rows().select("doc_id", "score"))


def every(spark: SparkSession, d: str, q: Q.Query, weighting=None) -> DataFrame:
    return rounded(documents(spark, d).searcher(weighting).matches(q))


def ids(spark: SparkSession, d: str, q: Q.Query) -> DataFrame:
    return documents(spark, d).searcher().docs_for_query(q)


OR3 = Q.Or((T("thre"), T("tion"), T("ble")))
_SUM = "SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id"

register("term_bm25_top10", f"WITH {BM25} {_SUM} ORDER BY sum(s) DESC, doc_id LIMIT 10")(lambda s, d: top(s, d, OR3))
register("or_bm25_all", f"WITH {BM25} {_SUM}")(lambda s, d: every(s, d, OR3))
register("bm25_parameters", f"""WITH {TOK} SELECT doc_id, round((ln(n / (df + 1.0)) + 1) * (tf * 3.0) / (tf + 2.0 * (0.5 + 0.5 * fl / avgfl)), 6) AS score
FROM post JOIN ts USING (t) JOIN len USING (doc_id) CROSS JOIN fs WHERE t = 'tion'""")(lambda s, d: every(s, d, T("tion"), BM25F(0.75, 2.0, text_B=0.5)))
register("tfidf_top10", f"WITH {TOK} SELECT doc_id, round(sum(tf * (ln(n / (df + 1.0)) + 1)), 6) AS score FROM post JOIN ts USING (t) CROSS JOIN fs WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id ORDER BY sum(tf * (ln(n / (df + 1.0)) + 1)) DESC, doc_id LIMIT 10")(lambda s, d: top(s, d, OR3, TF_IDF()))
register("frequency_scores", f"WITH {TOK} SELECT doc_id, round(sum(tf)::DOUBLE, 6) AS score FROM post WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id")(lambda s, d: every(s, d, OR3, Frequency()))
_PL2 = "(x * ln(1 / f) + f / ln(2) + 0.5 * ln(2 * pi() * x) + x * (ln(x) - 1 / ln(2))) / (x + 1)"
register("pl2_scores", f"WITH {TOK} SELECT doc_id, round({_PL2}, 6) AS score FROM (SELECT doc_id, tf * ln(1 + avgfl / fl) AS x, cf::DOUBLE / n AS f FROM post JOIN ts USING (t) JOIN len USING (doc_id) CROSS JOIN fs WHERE t = 'tion')")(lambda s, d: every(s, d, T("tion"), PL2()))
register("dfree_scores", f"""WITH {TOK} SELECT doc_id, round(tf * ln(post / prior) * (tf * ln(prior * c) + (tf + 1.0) * ln(post * c) + 0.5 * ln(post / prior)), 6) AS score
FROM (SELECT doc_id, tf, tf::DOUBLE / fl AS prior, (tf + 1.0) / (fl + 1.0) AS post, total::DOUBLE / cf AS c FROM post JOIN ts USING (t) JOIN len USING (doc_id) CROSS JOIN fs WHERE t = 'tion')""")(lambda s, d: every(s, d, T("tion"), DFree()))
register("reverse_weighting", f"WITH {BM25} SELECT doc_id, round(-sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id ORDER BY sum(s), doc_id LIMIT 10")(lambda s, d: top(s, d, OR3, ReverseWeighting(BM25F())))
register("function_weighting", f"WITH {TOK} SELECT doc_id, round(sqrt(tf) / fl, 6) AS score FROM post JOIN len USING (doc_id) WHERE t = 'tion'")(lambda s, d: every(s, d, T("tion"), FunctionWeighting(lambda x: F.sqrt(x.w) / x.length)))
register("multi_weighting", f"WITH {TOK} SELECT doc_id, round(coalesce(s, 0) + CASE WHEN lang = 'de' THEN 1 ELSE 0 END, 6) AS score FROM documents LEFT JOIN (SELECT doc_id, tf * (ln(n / (df + 1.0)) + 1) AS s FROM post JOIN ts USING (t) CROSS JOIN fs WHERE t = 'tion') USING (doc_id) WHERE s IS NOT NULL OR lang = 'de'")(
    lambda s, d: every(s, d, Q.Or((T("tion"), Q.Term("lang", "de"))), MultiWeighting(BM25F(), text=TF_IDF()))
)
register("boosted_terms", f"WITH {BM25} SELECT doc_id, round(sum(CASE t WHEN 'thre' THEN 2.5 * s ELSE s END), 6) AS score FROM bm WHERE t IN ('thre', 'ble') GROUP BY doc_id")(lambda s, d: every(s, d, Q.Or((T("thre", 2.5), T("ble")))))

_TREE = """(SELECT doc_id FROM bm WHERE t = 'thre' INTERSECT SELECT doc_id FROM bm WHERE t = 'tion')"""
register("and_or_not_matrix", f"WITH {BM25}, a AS {_TREE} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM bm WHERE t = 'ble') GROUP BY doc_id")(lambda s, d: every(s, d, Q.AndNot(Q.And((T("thre"), T("tion"))), T("ble"))))
register("and_score", f"WITH {BM25}, a AS {_TREE} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id IN (SELECT doc_id FROM a) GROUP BY doc_id")(lambda s, d: every(s, d, Q.And((T("thre"), T("tion")))))
register("and_with_not", f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM bm WHERE t = 'thre' AND doc_id NOT IN (SELECT doc_id FROM bm WHERE t IN ('ble', 'tion'))")(lambda s, d: every(s, d, Q.And((T("thre"), Q.Not(Q.Or((T("ble"), T("tion"))))))))
register("andmaybe_score", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id IN (SELECT doc_id FROM bm WHERE t = 'thre') GROUP BY doc_id")(lambda s, d: every(s, d, Q.AndMaybe(T("thre"), T("tion"))))
register("require_semi", f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM bm WHERE t = 'thre' AND doc_id IN (SELECT doc_id FROM bm WHERE t = 'tion')")(lambda s, d: every(s, d, Q.Require(T("thre"), T("tion"))))
register("dismax_score", f"WITH {BM25} SELECT doc_id, round(max(s) + 0.3 * (sum(s) - max(s)), 6) AS score FROM bm WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id")(lambda s, d: every(s, d, Q.DisjunctionMax(OR3.subs, tiebreak=0.3)))
register("or_minmatch", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id HAVING count(*) >= 2")(lambda s, d: every(s, d, Q.Or(OR3.subs, minmatch=2)))
register("or_coordination", f"WITH {BM25} SELECT doc_id, round((sum(s) + (count(*) - 1) / pow(3 - 0.9, 2)) * 2 / 3, 6) AS score FROM bm WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id")(lambda s, d: every(s, d, Q.Or(OR3.subs, scale=0.9)))
register("not_complement", f"WITH {TOK} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE t = 'tion')")(lambda s, d: ids(s, d, Q.Not(T("tion"))))
register("otherwise_fallback", f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM bm WHERE t = 'tion'")(lambda s, d: every(s, d, Q.Otherwise(T("nosuchterm"), T("tion"))))
register("otherwise_first", f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM bm WHERE t = 'thre'")(lambda s, d: every(s, d, Q.Otherwise(T("thre"), T("tion"))))
register("every_document", "SELECT doc_id, 2.0::DOUBLE AS score FROM documents")(lambda s, d: every(s, d, Q.Every(boost=2.0)))
register("every_field", f"WITH {TOK} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM tok")(lambda s, d: every(s, d, Q.Every("text")))
register("constant_score", f"WITH {TOK} SELECT DISTINCT doc_id, 3.5::DOUBLE AS score FROM post WHERE t IN ('thre', 'tion', 'ble')")(lambda s, d: every(s, d, Q.ConstantScore(OR3, 3.5)))
register("weighted_subtree", f"WITH {BM25} SELECT doc_id, round(coalesce(a.s, 0) + coalesce(b.tf, 0), 6) AS score FROM (SELECT doc_id, s FROM bm WHERE t = 'thre') a FULL JOIN (SELECT doc_id, tf FROM post WHERE t = 'ble') b USING (doc_id)")(lambda s, d: every(s, d, Q.Or((T("thre"), Q.Weighted(T("ble"), Frequency())))))
register("boolean_query", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id IN (SELECT doc_id FROM bm WHERE t = 'thre') AND doc_id NOT IN (SELECT doc_id FROM bm WHERE t = 'ble') GROUP BY doc_id")(lambda s, d: every(s, d, Q.BooleanQuery([T("thre")], [T("tion")], [T("ble")])))

register("prefix_terms", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE starts_with(t, 'thr')")(lambda s, d: ids(s, d, Q.Prefix("text", "thr")))
register("prefix_scored", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE starts_with(t, 'thr') GROUP BY doc_id")(lambda s, d: every(s, d, Q.Prefix("text", "thr", constantscore=False)))
register("wildcard_terms", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE regexp_full_match(t, 't.*re[ad].')")(lambda s, d: ids(s, d, Q.Wildcard("text", "t*re[ad]?")))
register("regex_terms", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE regexp_matches(t, '^(?:th(re|at)+n)')")(lambda s, d: ids(s, d, Q.Regex("text", "th(re|at)+n")))
register("fuzzy_terms", rf"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE starts_with(t, 't') AND levenshtein(regexp_replace(t, '[^\x00-\x7F]', '~', 'g'), 'thren') <= 1")(lambda s, d: ids(s, d, Q.FuzzyTerm("text", "thren")))
register("fuzzy_distance_two", rf"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE levenshtein(regexp_replace(t, '[^\x00-\x7F]', '~', 'g'), 'ation') <= 2")(lambda s, d: ids(s, d, Q.FuzzyTerm("text", "ation", maxdist=2, prefixlength=0)))
register("variations_terms", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE t IN ('tion', 'tions', 'tioned', 'tioning', 'tioner', 'tioners', 'tionest', 'tionly', 'tionness', 'tionable', 'tionful', 'tionless')")(lambda s, d: ids(s, d, Q.Variations("text", "tion")))
register("term_range", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE t >= 'thre' AND t < 'throu'")(lambda s, d: ids(s, d, Q.TermRange("text", "thre", "throu", endexcl=True)))
register("numeric_range_price", "SELECT o_orderkey AS doc_id FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 150000.5")(lambda s, d: orders(s, d).searcher().docs_for_query(Q.NumericRange("o_totalprice", 1000, 150000.5, startexcl=True)))
register("date_range_orders", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderdate >= TIMESTAMP '1994-03-01' AND o_orderdate < TIMESTAMP '1996-07-01'")(lambda s, d: orders(s, d).searcher().docs_for_query(Q.DateRange("o_orderdate", dt.datetime(1994, 3, 1), dt.datetime(1996, 7, 1), endexcl=True)))
register("column_query", "SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_custkey % 7 = 3")(lambda s, d: orders(s, d).searcher().matches(Q.ColumnQuery("o_custkey", lambda c: c % 7 == 3)))
register("term_and_range", f"WITH {BM25} SELECT doc_id, round(s + 1, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE t = 'tion' AND n_chars BETWEEN 500 AND 3000")(lambda s, d: every(s, d, Q.And((T("tion"), Q.NumericRange("n_chars", 500, 3000)))))

_PHRASE = f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos - a.pos BETWEEN 1 AND {{slop}}".replace("{{", "{").replace("}}", "}")
register("phrase_exact", _PHRASE.replace("{slop}", "1"))(lambda s, d: ids(s, d, Q.Phrase("text", ("er", "th"))))
register("phrase_slop", _PHRASE.replace("{slop}", "4"))(lambda s, d: ids(s, d, Q.Phrase("text", ("er", "th"), 4)))
register("phrase_scored", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('er', 'th') AND doc_id IN (SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos - a.pos = 1) GROUP BY doc_id")(lambda s, d: every(s, d, Q.Phrase("text", ("er", "th"))))
register("phrase_three_words", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id JOIN tok c ON a.doc_id = c.doc_id WHERE a.t = 'er' AND b.t = 'th' AND c.t = 'ed' AND b.pos - a.pos BETWEEN 1 AND 8 AND c.pos - b.pos BETWEEN 1 AND 8")(lambda s, d: ids(s, d, Q.Phrase("text", ("er", "th", "ed"), 8)))
register("span_unordered", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND abs(b.pos - a.pos) BETWEEN 1 AND 3")(lambda s, d: ids(s, d, Q.SpanNear((T("er"), T("th")), 3, ordered=False)))
register("span_mindist", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos - a.pos BETWEEN 3 AND 6")(lambda s, d: ids(s, d, Q.SpanNear((T("er"), T("th")), 6, mindist=3)))
register("ordered_anywhere", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos > a.pos")(lambda s, d: ids(s, d, Q.Ordered([T("er"), T("th")])))
register("span_first", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE t = 'er' AND pos <= 9")(lambda s, d: ids(s, d, Q.SpanFirst(T("er"), 9)))
register("span_not", f"WITH {TOK}, n AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos - a.pos BETWEEN 1 AND 5) SELECT DISTINCT doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM tok c WHERE c.doc_id = n.doc_id AND c.t = 'ed' AND c.pos BETWEEN n.s AND n.e)")(
    lambda s, d: ids(s, d, Q.SpanNot(Q.SpanNear((T("er"), T("th")), 5), T("ed")))
)
register("span_contains", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos - a.pos BETWEEN 1 AND 60 JOIN tok c ON c.doc_id = a.doc_id AND c.t = 'ed' AND c.pos BETWEEN a.pos AND b.pos")(lambda s, d: ids(s, d, Q.SpanContains(Q.SpanNear((T("er"), T("th")), 60), T("ed"))))
register("span_before", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN (SELECT doc_id, min(pos) AS p FROM tok WHERE t = 'th' GROUP BY doc_id) b ON a.doc_id = b.doc_id AND a.t = 'er' AND a.pos < b.p")(lambda s, d: ids(s, d, Q.SpanBefore(T("er"), T("th"))))
register("span_or", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE t IN ('er', 'th') AND pos <= 9")(lambda s, d: ids(s, d, Q.SpanFirst(Q.Or((T("er"), T("th"))), 9)))
register("span_condition", f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM bm WHERE t = 'er' AND doc_id IN (SELECT doc_id FROM post WHERE t = 'th')")(lambda s, d: every(s, d, Q.SpanCondition(T("er"), T("th"))))


def conversations(spark: SparkSession, d: str) -> FrameCorpus:
    c = table(spark, d, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return FrameCorpus(c.withColumns({"group_id": F.col("conv_id"), "seq_in_group": F.col("turn")}), Schema(text=TEXT(), role=ID(), turn=NUMERIC()))


_CONV = "(SELECT conv_id, turn, conv_id * 1000 + turn AS doc_id, text FROM conversations)"
_FIRST = Q.NumericRange("turn", 0, 0)
_OWN = "own AS (SELECT c.doc_id, max(p.doc_id) AS parent FROM conv c JOIN conv p ON p.conv_id = c.conv_id AND p.turn = 0 AND p.turn <= c.turn WHERE c.turn > 0 GROUP BY c.doc_id)"
register("nested_parent", f"WITH conv AS {_CONV}, {tokens_sql('conv').replace('WITH ', '')}, {_OWN} SELECT parent AS doc_id, count(*)::DOUBLE AS score FROM own WHERE doc_id IN (SELECT doc_id FROM post WHERE t IN ('er', 'th', 'ed', 'the')) GROUP BY parent")(
    lambda s, d: conversations(s, d).searcher().matches(Q.NestedParent(_FIRST, Q.ConstantScore(Q.Or((T("er"), T("th"), T("ed"))))))
)
register("nested_children", f"WITH conv AS {_CONV}, {tokens_sql('conv')}, {_OWN} SELECT doc_id FROM own WHERE parent IN (SELECT doc_id FROM post WHERE t IN ('er', 'th', 'ed'))")(lambda s, d: conversations(s, d).searcher().docs_for_query(Q.NestedChildren(_FIRST, Q.And((_FIRST, Q.Or((T("er"), T("th"), T("ed"))))))))

register("filter_mask", f"WITH {BM25} SELECT doc_id, round(s, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE t = 'tion' AND lang = 'en' AND source <> 'src3'")(
    lambda s, d: rounded(documents(s, d).searcher().search(T("tion"), limit=None, filter=Q.Term("lang", "en"), mask=Q.Term("source", "src3")).rows().select("doc_id", "score"))
)
register("sort_multi_reverse", "SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders ORDER BY rank LIMIT 50")(
    lambda s, d: orders(s, d).searcher().search(Q.Every(), limit=50, sortedby=[fc.FieldFacet("o_orderstatus"), fc.FieldFacet("o_totalprice", reverse=True)]).rows().select("doc_id", "rank")
)
register("sort_reversed", "SELECT o_orderkey AS doc_id, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey DESC)::INTEGER AS rank FROM orders ORDER BY rank LIMIT 25")(lambda s, d: orders(s, d).searcher().search(Q.Every(), limit=25, sortedby="o_orderpriority", reverse=True).rows().select("doc_id", "rank"))
register("search_page", f"WITH {BM25}, h AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM bm WHERE t = 'tion') SELECT doc_id, round(s, 6) AS score FROM h WHERE n BETWEEN 11 AND 20")(lambda s, d: rounded(documents(s, d).searcher().search_page(T("tion"), 2).rows().select("doc_id", "score")))
register("collapse_by_source", f"WITH {BM25}, h AS (SELECT doc_id, s, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS n FROM bm JOIN documents USING (doc_id) WHERE t = 'tion') SELECT doc_id, round(s, 6) AS score FROM h WHERE n <= 2")(
    lambda s, d: rounded(documents(s, d).searcher().search(T("tion"), limit=None, collapse="source", collapse_limit=2).rows().select("doc_id", "score"))
)
register("collapse_order", "WITH h AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) SELECT o_orderkey AS doc_id FROM h WHERE n = 1")(lambda s, d: orders(s, d).searcher().search(Q.Every(), limit=None, collapse="o_custkey", collapse_order="o_totalprice").rows().select("doc_id"))
register("matched_terms", f"WITH {TOK} SELECT doc_id, string_agg('text:' || t, ',' ORDER BY t) AS matched FROM post WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id")(lambda s, d: documents(s, d).searcher().search(OR3, limit=None, terms=True).matched_terms().select("doc_id", F.array_join(F.array_sort("matched"), ",").alias("matched")))


def _groups(c: FrameCorpus, q: Q.Query, by, kind=fc.Count) -> DataFrame:
    return c.searcher().search(q, groupedby={"g": by}, maptype=kind).groups("g")


register("facet_count_lang", f"WITH {TOK} SELECT lang AS key, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM post WHERE t = 'tion') GROUP BY lang")(lambda s, d: _groups(documents(s, d), T("tion"), "lang"))
register("facet_range_price", "SELECT floor(p_retailprice / 100) * 100 AS low, count(*) AS n FROM part WHERE p_retailprice >= 0 AND p_retailprice < 3000 GROUP BY 1")(lambda s, d: _groups(parts(s, d), Q.Every(), fc.RangeFacet("p_retailprice", 0, 3000, 100)).where("key is not null").select("key.low", "n"))
register("facet_range_gaps", "SELECT CASE WHEN p_size < 5 THEN 0.0 WHEN p_size < 15 THEN 5.0 WHEN p_size < 25 THEN 15.0 WHEN p_size < 35 THEN 25.0 ELSE 35.0 END::DOUBLE AS low, count(*) AS n FROM part WHERE p_size >= 0 AND p_size < 45 GROUP BY 1")(lambda s, d: _groups(parts(s, d), Q.Every(), fc.RangeFacet("p_size", 0, 40, [5, 10])).where("key is not null").select("key.low", "n"))
register("facet_date_month", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS low, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")(
    lambda s, d: _groups(orders(s, d), Q.Every(), fc.DateRangeFacet("o_orderdate", dt.datetime(1993, 1, 1), dt.datetime(1997, 1, 1), "1 month")).where("key is not null").select(F.date_format("key.low", "yyyy-MM-dd").alias("low"), "n")
)
register("facet_overlap_ptype", "SELECT key, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_type, '[ ,]+')) AS key FROM part) GROUP BY key")(lambda s, d: _groups(parts(s, d), Q.Every(), fc.FieldFacet("p_type", overlap=True)))
register("facet_query", f"WITH {TOK} SELECT CASE WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'rest' END AS key, count(*) AS n FROM (SELECT doc_id IN (SELECT doc_id FROM post WHERE t = 'thre') AS a, doc_id IN (SELECT doc_id FROM post WHERE t = 'ble') AS b FROM documents) GROUP BY 1")(lambda s, d: _groups(documents(s, d), Q.Every(), fc.QueryFacet({"first": T("thre"), "second": T("ble")}, other="rest")))
register("facet_multi", "SELECT o_orderstatus AS k0, o_orderpriority AS k1, count(*) AS n FROM orders GROUP BY 1, 2")(lambda s, d: _groups(orders(s, d), Q.Every(), fc.facet(["o_orderstatus", "o_orderpriority"])).select("key.k0", "key.k1", "n"))
register("facet_translate", "SELECT substr(o_orderpriority, 1, 1) || o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: _groups(orders(s, d), Q.Every(), fc.TranslateFacet(lambda a, b: F.concat(F.substring(a, 1, 1), b), [fc.FieldFacet("o_orderpriority"), fc.FieldFacet("o_orderstatus")])))
register("facet_function", "SELECT o_custkey % 5 AS key, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: _groups(orders(s, d), Q.Every(), fc.FunctionFacet(lambda: F.col("o_custkey") % 5)))
register("facet_best", f"WITH {BM25} SELECT source AS key, arg_min(doc_id, (-s, doc_id)) AS doc_id FROM bm JOIN documents USING (doc_id) WHERE t = 'tion' GROUP BY source")(lambda s, d: _groups(documents(s, d), T("tion"), "source", fc.Best))
register("facet_ordered_list", f"WITH {BM25} SELECT lang AS key, string_agg(doc_id::VARCHAR, ',' ORDER BY s DESC, doc_id) AS docs FROM bm JOIN documents USING (doc_id) WHERE t = 'tion' GROUP BY lang")(lambda s, d: _groups(documents(s, d), T("tion"), "lang", fc.OrderedList).select("key", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs")))
register("stored_fields", f"WITH {BM25} SELECT doc_id, lang, source, round(s, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE t = 'tion' ORDER BY s DESC, doc_id LIMIT 10")(lambda s, d: rounded(documents(s, d).searcher().search(T("tion")).fields("lang", "source").select("doc_id", "lang", "source", "score")))
register("keyword_terms", "SELECT p_partkey AS doc_id, len(list_filter(regexp_extract_all(p_type, '[^ ]+'), lambda x: x = 'PROMO'))::DOUBLE AS score FROM part WHERE list_contains(regexp_extract_all(p_type, '[^ ]+'), 'PROMO')")(lambda s, d: parts(s, d).searcher(Frequency()).matches(Q.Term("p_type", "PROMO")))
