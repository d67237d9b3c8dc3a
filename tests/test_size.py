"""Steps that have to grow no faster than their input, held against plain ones."""

import hashlib
import inspect

import regex
from pyspark.sql import functions as F

from wordloom.functions import analysis as an
from wordloom.functions.formats import TEXT, Schema
from wordloom.operators import classify
from wordloom.operators import query as Q
from wordloom.operators.highlight import offsets
from wordloom.plans import catalog_analysis, catalog_index
from wordloom.sources.corpus import FrameCorpus

TEXTS = ["Alfa bravo alfa Délta", None, "", "bravo", "alfa bravo", " . ", "x.y bravo charlie delta echo alfa bravo"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_simhash_counts_bits_in_batches(spark, monkeypatch):
    """F9"""
    made = classify.simhash(F.array_distinct(an.SimpleAnalyzer().terms(F.col("text"))), hashed=classify.md5_hash)
    plan = frame(spark).select(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "_majority" in plan
    for r in frame(spark).select("text", made.alias("h")).collect():
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set(regex.findall(an.WORD, (r.text or "").lower()))]
        assert r.h % (1 << 64) == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    few = spark.sql("SELECT explode(array(array('a', 'b', NULL), array(), NULL)) AS x")
    assert [r.h for r in few.select(classify.simhash(F.col("x"), F.transform("x", lambda _: F.lit(1.0))).alias("h")).collect()] == [r.h for r in few.select(classify.simhash(F.col("x")).alias("h")).collect()]


def test_offsets_hold_one_text(spark):
    """F10"""
    assert "to_pylist" not in inspect.getsource(offsets)
    for r in frame(spark).select("text", offsets(F.col("text")).alias("o")).collect():
        plain = None if r.text is None else [(m[0].lower(), i, m.start(), m.end()) for i, m in enumerate(regex.finditer(an.WORD, r.text))]
        assert (r.o and list(map(tuple, r.o))) == plain


def test_scored_queries_read_texts_once(spark):
    """F11, F15, F17, F20"""
    texts = frame(spark)
    c = FrameCorpus(texts, Schema(text=TEXT()))
    for q in (Q.Phrase("text", ("alfa", "bravo")), Q.Prefix("text", "br", constantscore=False)):
        found = c.searcher().matches(q)
        assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() == (3 if isinstance(q, Q.Phrase) else 4)


def test_shingles_of_strings(spark):
    """F12, F19"""
    for a in (an.SimpleAnalyzer() | an.ShingleFilter(3), an.SimpleAnalyzer() | an.BiWordFilter()):
        assert a.strings(F.col("text")) is not None and a.numbered(F.col("text")) is None
        assert all(r.a == r.b for r in frame(spark).select(a.strings(F.col("text")).alias("a"), a.terms(F.col("text")).alias("b")).collect())


def test_vectors_of_all_documents_need_no_join(spark):
    """F14, F16"""
    c = FrameCorpus(frame(spark), Schema(text=TEXT()))
    every = c.vector("text", positions=False)
    assert "Join" not in every._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, c.vector("text", c.docs()).drop("positions").select(every.columns).collect()))
    assert all("c.vector(\"text\", positions=False)" in inspect.getsource(m) for m in (catalog_analysis, catalog_index))


def test_glob_tells_its_start_to_the_scan():
    """F13"""
    line = next(x for x in inspect.getsource(catalog_analysis).splitlines() if x.startswith('register("glob_terms"'))
    assert 'startswith("t")' in line
