"""Queries of analysis and of terms: tokens, n-grams, shingles, paths, lexicons and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import analysis as an
from wordloom.functions import automata as au
from wordloom.functions import phonetic
from wordloom.operators import classify
from wordloom.operators.highlight import offsets
from wordloom.operators.spelling import suggestions
from wordloom.plans.catalog import TOK, WORD, register
from wordloom.plans.catalog_search import documents, table
from wordloom.sources.corpus import spread


def exploded(spark: SparkSession, d: str, analyzer: an.Analyzer, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = spread(table(spark, d, name)).select(F.col(key).alias("doc_id"), F.explode(analyzer.tokens(F.col(text))).alias("x"))
    return rows.select("doc_id", F.col("x.t").alias("t"), F.col("x.pos").alias("pos"))


def words(spark: SparkSession, d: str, analyzer: an.Analyzer) -> DataFrame:
    """The terms of documents without their places."""
    return spread(table(spark, d, "documents")).select(F.explode(analyzer.strings(F.col("text"))).alias("t"))


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("t").agg(F.count(F.lit(1)).alias("n"))


register("standard_tokens", f"WITH {TOK} SELECT doc_id, t, pos::INTEGER AS pos FROM tok")(lambda s, d: exploded(s, d, an.StandardAnalyzer()))
register("simple_terms", f"SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM documents) GROUP BY t")(lambda s, d: counted(exploded(s, d, an.SimpleAnalyzer())))
register("keyword_analysis", "SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_type), '[^ \\t\\r\\n]+')) AS t FROM part) GROUP BY t")(lambda s, d: counted(exploded(s, d, an.KeywordAnalyzer(lowercase=True), "part", "p_partkey", "p_type")))
register("ngram_terms", "SELECT substr(lower(n_name), i, k) AS t, count(*) AS n FROM nation, range(1, 30) r(i), range(2, 5) q(k) WHERE i + k - 1 <= length(n_name) GROUP BY 1")(lambda s, d: counted(exploded(s, d, an.NgramAnalyzer(2, 4), "nation", "n_nationkey", "n_name")))
register("ngram_word_starts", f"SELECT substr(w, 1, k) AS t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '{WORD}')) AS w FROM part), range(2, 5) q(k) WHERE length(w) >= k GROUP BY 1")(lambda s, d: counted(exploded(s, d, an.NgramWordAnalyzer(2, 4, at="start"), "part", "p_partkey", "p_name")))
register("shingle_terms", f"WITH w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS l FROM documents)) SELECT s AS t, count(*) AS n FROM (SELECT t || '-' || lead(t) OVER w1 || '-' || lead(t, 2) OVER w1 AS s FROM w WINDOW w1 AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL GROUP BY s")(
    lambda s, d: counted(words(s, d, an.SimpleAnalyzer() | an.ShingleFilter(3)))
)
register("biword_terms", f"WITH w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS l FROM documents)) SELECT s AS t, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN t ELSE t || '-' || lead(t) OVER (PARTITION BY doc_id ORDER BY i) END AS s FROM w) WHERE s IS NOT NULL GROUP BY s")(lambda s, d: counted(words(s, d, an.SimpleAnalyzer() | an.BiWordFilter())))
register("path_terms", "WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS u FROM pages), q AS (SELECT list_filter(string_split(u, '/'), lambda x: x <> '') AS l FROM p) SELECT array_to_string(l[1:i], '/') AS t, count(*) AS n FROM q, range(1, 12) r(i) WHERE i <= len(l) GROUP BY 1")(
    lambda s, d: counted(exploded_path(s, d))
)
register("substitution_filter", f"SELECT regexp_replace(t, 'th', 'z', 'g') AS t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM documents) GROUP BY 1")(lambda s, d: counted(exploded(s, d, an.SimpleAnalyzer() | an.SubstitutionFilter("th", "z"))))
register("reverse_terms", f"SELECT reverse(t) AS t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '{WORD}')) AS t FROM part) GROUP BY 1")(lambda s, d: counted(exploded(s, d, an.SimpleAnalyzer() | an.ReverseTextFilter(), "part", "p_partkey", "p_name")))
register("accent_folding", f"SELECT translate(t, 'äöüéèêçñóíá', 'aoueeecnoia') AS t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM documents) GROUP BY 1")(lambda s, d: counted(exploded(s, d, an.SimpleAnalyzer() | an.CharsetFilter(dict(zip("äöüéèêçñóíá", "aoueeecnoia"))))))
register("stop_filter_sizes", f"SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS t FROM documents) WHERE length(t) BETWEEN 3 AND 6 AND t NOT IN ('the', 'and') GROUP BY t")(lambda s, d: counted(exploded(s, d, an.SimpleAnalyzer() | an.StopFilter(("the", "and"), 3, 6))))
register("gap_tokens", "SELECT t, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda x: x <> '')) AS t FROM documents) GROUP BY t")(lambda s, d: counted(exploded(s, d, an.RegexAnalyzer(r"[^\p{L}]+", gaps=True))))


def exploded_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").withColumn("u", F.regexp_replace("url", "^[a-z]+://", ""))
    return rows.select(F.explode(an.Analyzer([an.PathTokenizer()]).terms(F.col("u"))).alias("t"))


register("lexicon_stats", f"WITH {TOK} SELECT t AS term, count(*) AS df, sum(tf)::DOUBLE AS cf, max(tf)::DOUBLE AS max_weight, min(fl)::INTEGER AS min_length, max(fl)::INTEGER AS max_length FROM post JOIN len USING (doc_id) GROUP BY t")(lambda s, d: documents(s, d).lexicon("text"))
register("lexicon_prefix", f"WITH {TOK} SELECT t AS term, df FROM ts WHERE starts_with(t, 'ation')")(lambda s, d: documents(s, d).terms_with("text", lambda t: t.startswith("ation")).select("term", "df"))
register("terms_from", f"WITH {TOK} SELECT t AS term FROM ts WHERE t >= 'thr'")(lambda s, d: documents(s, d).terms_with("text", lambda t: t >= "thr").select("term"))
register("most_frequent_terms", f"WITH {TOK} SELECT t AS term, cf::DOUBLE AS cf FROM ts ORDER BY cf DESC, t LIMIT 20")(lambda s, d: documents(s, d).most_frequent_terms("text", 20))
register("most_distinctive_terms", f"WITH {TOK} SELECT t AS term, round(cf * ln(n::DOUBLE / df), 6) AS score FROM ts CROSS JOIN fs ORDER BY cf * ln(n::DOUBLE / df) DESC, t LIMIT 20")(lambda s, d: documents(s, d).most_distinctive_terms("text", 20).select("term", F.round("score", 6).alias("score")))
register("field_statistics", f"WITH {TOK} SELECT n, total::BIGINT AS total_text, round(avgfl, 6) AS avg_text FROM fs")(lambda s, d: documents(s, d).field_stats(["text"]).select("n", "total_text", F.round("avg_text", 6).alias("avg_text")))
register("field_lengths", f"WITH {TOK} SELECT min(fl)::INTEGER AS shortest, max(fl)::INTEGER AS longest FROM len")(lambda s, d: documents(s, d).tokens("text").select(F.size("tokens").alias("n")).where("n > 0").agg(F.min("n").alias("shortest"), F.max("n").alias("longest")))
register("postings_positions", f"WITH {TOK} SELECT doc_id, count(*)::INTEGER AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok WHERE t = 'thre' GROUP BY doc_id")(lambda s, d: documents(s, d).postings("text", lambda t: t == "thre", True).select("doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")))
register("vector_terms", f"WITH {TOK} SELECT t AS term, doc_id, tf::INTEGER AS tf FROM post")(lambda s, d: (lambda c: c.vector("text", positions=False).select("term", "doc_id", "tf"))(documents(s, d)))
register("spelling_suggest", rf"WITH {TOK}, lv AS (SELECT *, levenshtein(regexp_replace(t, '[^\x00-\x7F]', '~', 'g'), 'thrion') AS d FROM ts) SELECT t AS term, d::INTEGER AS distance, cf::DOUBLE AS cf FROM lv WHERE d <= 2 ORDER BY 2, cf DESC, t LIMIT 10")(lambda s, d: suggestions(documents(s, d), "text", "thrion", 10))

_KEYS = """, own AS (SELECT t, sum(tf) AS top FROM post WHERE doc_id IN (3, 5, 8) GROUP BY t), tt AS (SELECT sum(top) AS tt FROM own),
r AS (SELECT t, {formula} AS raw FROM own JOIN ts USING (t) CROSS JOIN fs CROSS JOIN tt), b AS (SELECT * FROM r WHERE raw > 0 ORDER BY raw DESC, t LIMIT 8)
SELECT t AS term, round(raw / max(raw) OVER (), 6) AS score FROM b"""
_FORMULA = {
    "bo1": "top * log2((1.0 + cf::DOUBLE / n) / (cf::DOUBLE / n)) + log2(1.0 + cf::DOUBLE / n)",
    "bo2": "top * log2((1.0 + top * tt::DOUBLE / total) / (top * tt::DOUBLE / total)) + log2(1.0 + top * tt::DOUBLE / total)",
    "kl": "CASE WHEN top::DOUBLE / tt < cf::DOUBLE / total THEN 0 ELSE (top::DOUBLE / tt) * log2((top::DOUBLE / tt) / (top::DOUBLE / total)) END",
}
for _model, _f in _FORMULA.items():
    register(f"key_terms_{_model}", f"WITH {TOK}" + _KEYS.replace("{formula}", _f))(
        lambda s, d, m=_model: (lambda c: classify.key_terms(c, c.docs().where("doc_id in (3, 5, 8)"), "text", 8, m).withColumn("score", F.round("score", 6)))(documents(s, d))
    )


def more_like(spark: SparkSession, d: str) -> DataFrame:
    found = documents(spark, d).searcher().more_like(48, "text", top=10)
    return found.rows().select("doc_id", F.round("score", 6).alias("score"))


register(
    "more_like_doc",
    f"""WITH {TOK}, own AS (SELECT t, sum(tf) AS top FROM post WHERE doc_id = 48 GROUP BY t),
r AS (SELECT t, {_FORMULA['bo1']} AS raw FROM own JOIN ts USING (t) CROSS JOIN fs), b AS (SELECT * FROM r WHERE raw > 0 ORDER BY raw DESC, t LIMIT 5),
k AS (SELECT t, raw / max(raw) OVER () AS w FROM b)
SELECT doc_id, round(sum(w * (ln(n / (df + 1.0)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * fl / avgfl))), 6) AS score
FROM post JOIN ts USING (t) JOIN len USING (doc_id) JOIN k USING (t) CROSS JOIN fs WHERE doc_id <> 48 GROUP BY doc_id ORDER BY sum(w * (ln(n / (df + 1.0)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * fl / avgfl))) DESC, doc_id LIMIT 10""",
)(more_like)


register("character_offsets", f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t, regexp_split_to_array(text, '{WORD}') AS g FROM documents),
r AS (SELECT doc_id, unnest(t) AS t, unnest(g[1:len(t)]) AS g, generate_subscripts(t, 1) AS i FROM l)
SELECT doc_id, lower(t) AS t, (i - 1)::INTEGER AS pos, (sum(length(g) + length(t)) OVER w - length(t))::INTEGER AS startchar, (sum(length(g) + length(t)) OVER w)::INTEGER AS endchar FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")(
    lambda s, d: spread(table(s, d, "documents")).select("doc_id", F.inline(offsets(F.col("text")))).select("doc_id", "t", "pos", "startchar", "endchar")
)
register("automaton_terms", rf"WITH {TOK} SELECT t AS term, df FROM ts WHERE levenshtein(regexp_replace(t, '[^\x00-\x7F]', '~', 'g'), 'ation') <= 1 AND starts_with(t, 'a')")(
    lambda s, d: documents(s, d).lexicon("text").where(au.term_predicate(au.levenshtein_automaton("ation", 1, prefix=1).to_dfa())(F.col("term"))).select("term", "df")
)
register("glob_terms", f"WITH {TOK} SELECT t AS term, df FROM ts WHERE regexp_full_match(t, 't.*r[^ei].')")(lambda s, d: documents(s, d).terms_with("text", lambda t: t.startswith("t")).where(au.term_predicate(au.glob_automaton("t*r[!ei]?"))(F.col("term"))).select("term", "df"))
register("phonetic_codes", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT w, translate(w, 'aeiouyhwbfpvcgjkqsxzdtlmnr', '00000000111122222222334556') AS c FROM w),
k AS (SELECT w, c, unnest(range(2, length(c) + 1)) AS i FROM c)
SELECT w.w AS t, substr(w.w, 1, 1) || coalesce((SELECT string_agg(substr(k.c, i, 1), '' ORDER BY i) FROM k WHERE k.w = w.w AND substr(k.c, i, 1) <> substr(k.c, i - 1, 1)), '') AS code FROM w""")(
    lambda s, d: spread(table(s, d, "documents")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("t")).distinct().select("t", an.each_word(F.col("t"), phonetic.soundex_en).alias("code"))
)
