"""Queries of the rest: parsed strings, excerpts, similarity, clustering, changes to documents, stems, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import analysis as an
from wordloom.functions import text as tx
from wordloom.operators import classify
from wordloom.operators import query as Q
from wordloom.operators.highlight import Highlighter, SentenceFragmenter, highlights
from wordloom.plans.catalog import BM25, TOK, WORD, register
from wordloom.plans.catalog_search import T, documents, orders, rounded, table
from wordloom.plans.dates import DateParser
from wordloom.plans.parser import ALL, MultifieldParser, QueryParser


def parsed(spark: SparkSession, d: str, text: str) -> DataFrame:
    c = documents(spark, d)
    return rounded(c.searcher().matches(QueryParser("text", c.schema, spark, ALL).parse(text)))


register("parsed_boolean", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id NOT IN (SELECT doc_id FROM bm WHERE t = 'ble') GROUP BY doc_id")(lambda s, d: parsed(s, d, "(thre OR tion) ANDNOT ble"))
register("parsed_field_and_range", f"WITH {BM25} SELECT doc_id, round(s * 2 + 1, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE t = 'tion' AND n_chars BETWEEN 400 AND 4000")(lambda s, d: parsed(s, d, "tion^2 n_chars:[400 TO 4000]"))
register("parsed_plus_minus", f"WITH {BM25} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id IN (SELECT doc_id FROM bm WHERE t = 'thre') AND doc_id NOT IN (SELECT doc_id FROM bm WHERE t = 'ble') GROUP BY doc_id")(lambda s, d: parsed(s, d, "+thre tion -ble"))
register("parsed_phrase", f"WITH {TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'er' AND b.t = 'th' AND b.pos - a.pos BETWEEN 1 AND 3")(lambda s, d: (lambda c: c.searcher().docs_for_query(QueryParser("text", c.schema, s).parse('"er th"~3')))(documents(s, d)))
register("parsed_date", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'")(
    lambda s, d: (lambda c: c.searcher().docs_for_query(QueryParser("o_orderstatus", c.schema, s, ALL, dates=DateParser(dt.datetime(2000, 1, 1))).parse("o_orderdate:'march 1995'")))(orders(s, d))
)
register("parsed_multifield", f"WITH {TOK} SELECT DISTINCT doc_id FROM documents LEFT JOIN post USING (doc_id) WHERE t = 'tion' OR lang = 'tion'")(lambda s, d: (lambda c: c.searcher().docs_for_query(MultifieldParser(["text", "lang"], c.schema, s).parse("tion")))(documents(s, d)))
register("parsed_fuzzy_wildcard", f"WITH {TOK} SELECT DISTINCT doc_id FROM post WHERE regexp_full_match(t, 'th.re') OR starts_with(t, 'ation')")(lambda s, d: (lambda c: c.searcher().docs_for_query(QueryParser("text", c.schema, s, ALL).parse("th?re OR ation*")))(documents(s, d)))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    found = documents(spark, d).searcher().search(Q.Or((T("thre"), T("tion"))), limit=20)
    return highlights(found, "text", Highlighter(SentenceFragmenter()))


register("highlight_excerpts")(excerpts)


def simhashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", classify.simhash(F.array_distinct(an.SimpleAnalyzer().terms(F.col("text"))), hashed=classify.md5_hash).alias("h"))
    return rows.select("doc_id", F.lower(F.hex("h")).alias("simhash"))


register("simhash_documents", f"""WITH term AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS t FROM documents),
bit AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM term), range(64) r(i) GROUP BY doc_id, i)
SELECT doc_id, coalesce(lower(to_hex(sum(CASE WHEN s > 0 THEN pow(2.0, i)::HUGEINT ELSE 0 END)::UBIGINT)), '0') AS simhash FROM documents LEFT JOIN bit USING (doc_id) GROUP BY doc_id""")(simhashes)
register("hamming_distance", "SELECT o_orderkey AS doc_id, bit_count(xor(o_orderkey, o_custkey))::INTEGER AS distance FROM orders")(lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), classify.hamming_distance(F.col("o_orderkey"), F.col("o_custkey")).cast("int").alias("distance")))
register("shingles_of_names", "SELECT n_name, substr(n_name, i, 3) AS shingle, count(*) AS n FROM nation, range(1, 40) r(i) WHERE i + 2 <= length(n_name) GROUP BY 1, 2")(lambda s, d: table(s, d, "nation").select("n_name", F.explode(classify.shingles(F.col("n_name"), 3)).alias("shingle")).groupBy("n_name", "shingle").agg(F.count(F.lit(1)).alias("n")))
register("kmeans_clusters", """WITH RECURSIVE it AS (SELECT 0 AS n, 60000.0::DOUBLE AS a, 140000.0::DOUBLE AS b, 380000.0::DOUBLE AS c, 1e9::DOUBLE AS moved
  UNION ALL SELECT n + 1, x, y, z, greatest(abs(x - a), abs(y - b), abs(z - c)) FROM (SELECT n, a, b, c,
    coalesce(avg(o_totalprice) FILTER (WHERE o_totalprice <= (a + b) / 2), a) AS x, coalesce(avg(o_totalprice) FILTER (WHERE o_totalprice > (a + b) / 2 AND o_totalprice <= (b + c) / 2), b) AS y,
    coalesce(avg(o_totalprice) FILTER (WHERE o_totalprice > (b + c) / 2), c) AS z FROM it, orders WHERE moved > 1e-4 AND n < 50 GROUP BY n, a, b, c))
SELECT o_orderkey, CASE WHEN o_totalprice <= (a + b) / 2 THEN 0 WHEN o_totalprice <= (b + c) / 2 THEN 1 ELSE 2 END AS cluster FROM orders, (SELECT * FROM it ORDER BY n DESC LIMIT 1)""")(
    lambda s, d: classify.kmeans(table(s, d, "orders"), "o_totalprice", 3, centers=[60000.0, 140000.0, 380000.0]).select("o_orderkey", "cluster")
)
register("sample_variance", "SELECT round(var_samp(o_totalprice), 2) AS variance FROM orders")(lambda s, d: classify.variance(table(s, d, "orders"), "o_totalprice").select(F.round("variance", 2).alias("variance")))
register("weighted_variance", "SELECT round(sum(l_quantity * (l_discount - m) * (l_discount - m)) / (sum(l_quantity) - 1), 8) AS variance FROM lineitem, (SELECT sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem)")(lambda s, d: classify.variance(table(s, d, "lineitem"), "l_discount", "l_quantity").select(F.round("variance", 8).alias("variance")))
def _windows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return part.join(classify.swin(part, "p_size", 5, "p_brand").withColumnRenamed("start", "p_size"), ["p_brand", "p_size"]).select("p_size", "p_partkey", "stop", F.col("n").alias("n_within"))


register("sliding_windows", "SELECT p_size, p_partkey, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND q.p_size BETWEEN p.p_size AND p.p_size + 5) AS n_within, (SELECT max(q.p_size) FROM part q WHERE q.p_brand = p.p_brand AND q.p_size BETWEEN p.p_size AND p.p_size + 5) AS stop FROM part p")(_windows)
register("sliding_windows_all", "WITH v AS (SELECT DISTINCT o_custkey AS start FROM orders) SELECT start, max(o_custkey) AS stop, count(*) AS n FROM v JOIN orders ON o_custkey BETWEEN start AND start + 10 GROUP BY start")(lambda s, d: classify.swin(table(s, d, "orders"), "o_custkey", 10))
register("natural_order", "SELECT c_custkey, 'c' || c_custkey % 1000 AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 1000, c_custkey)::INTEGER AS place FROM customer")(
    lambda s, d: table(s, d, "customer").withColumn("name", F.concat(F.lit("c"), F.col("c_custkey") % 1000)).select("c_custkey", "name", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(tx.natural_sort_key(F.col("name")), "c_custkey")).alias("place"))
)


def stemmed(spark: SparkSession, d: str) -> DataFrame:
    analyzer = an.RegexAnalyzer(r"[a-z]+") | an.StemFilter()
    return table(spark, d, "documents").select(F.explode(analyzer.terms(F.lower("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


register("stemmed_terms")(stemmed)
register("results_upgrade", f"WITH {BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM bm WHERE t = 'tion' ORDER BY r LIMIT 10) SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id IN (SELECT doc_id FROM bm WHERE t = 'thre') THEN 0 ELSE 1 END, r)::INTEGER AS rank FROM a")(
    lambda s, d: (lambda x: x.search(T("tion")).upgrade(x.search(T("thre"), limit=None)).rows().select("doc_id", "rank"))(documents(s, d).searcher())
)
register("results_extend", f"WITH {BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r, 0 AS p FROM bm WHERE t = 'tion' ORDER BY r LIMIT 5), b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r, 1 AS p FROM bm WHERE t = 'ble' ORDER BY r LIMIT 5) SELECT doc_id, row_number() OVER (ORDER BY p, r)::INTEGER AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a))")(
    lambda s, d: (lambda x: x.search(T("tion"), limit=5).extend(x.search(T("ble"), limit=5)).rows().select("doc_id", "rank"))(documents(s, d).searcher())
)
register("collapse_lost_counts", f"WITH {TOK} SELECT lang AS key, count(*) - 1 AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM post WHERE t = 'tion') GROUP BY lang HAVING count(*) > 1")(lambda s, d: documents(s, d).searcher().search(T("tion"), collapse="lang").collapsed_counts())
register("suggest_by_prefix", f"SELECT t AS term, count(*)::DOUBLE AS cf FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM documents) WHERE starts_with(t, 'enti') GROUP BY t ORDER BY cf DESC, t LIMIT 10")(lambda s, d: documents(s, d).most_frequent_terms("text", 10, "enti"))
