"""Queries over an index on disk that was written, updated, deleted from and merged, and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.formats import ID, NUMERIC, TEXT, Schema
from wordloom.operators import facets as fc
from wordloom.operators import query as Q
from wordloom.plans.catalog import register, tokens_sql
from wordloom.plans.catalog_search import OR3, T, rounded, table
from wordloom.sources.corpus import FrameCorpus
from wordloom.sources.index import BufferedWriter, Index, QueuedWriter, Together, add_sortable, copy_to, create_in, open_dir
from wordloom.sources.scratch import new_path
from wordloom.streaming.ingest import counts_by_window, latest, stream_into

_BUILT: dict[tuple[str, str, str], str] = {}


def schema() -> Schema:
    return Schema(text=TEXT(stored=True), lang=ID(stored=True, sortable=True), source=ID(stored=True, sortable=True), n_chars=NUMERIC())


def once(spark: SparkSession, d: str, what: str, build) -> str:
    """The path of something that is written once a session and folder."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _BUILT:
        build(path := new_path(spark, f"index-{what}"))
        _BUILT[key] = path  # not before it is whole
    return _BUILT[key]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _write(spark: SparkSession, d: str, path: str) -> None:
    """Two commits of documents, one of replaced ones, one of deletions."""
    docs = documents(spark, d)
    ix = create_in(spark, path, schema())
    for k in (0, 1):
        w = ix.writer()
        w.add_documents(docs.where(F.col("doc_id") % 2 == k))
        w.commit()
    w = ix.writer()
    w.update_documents(docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("thre tion "), "lang", F.lit(" renewed"))))
    w.commit()
    ix.delete_by_term("source", "src3")


def index(spark: SparkSession, d: str) -> Index:
    return open_dir(spark, once(spark, d, "main", lambda p: _write(spark, d, p)), schema())


def optimized(spark: SparkSession, d: str) -> Index:
    return open_dir(spark, once(spark, d, "optimized", lambda p: index(spark, d).optimize_to(p)), schema())


_LIVE = "live AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'thre tion ' || lang || ' renewed' ELSE text END AS text, lang, source, n_chars FROM documents WHERE source <> 'src3')"
_TOK = f"WITH {_LIVE}, {tokens_sql('live')}"
_BM = _TOK + """, bm AS (SELECT p.t, p.doc_id, (ln(n / (df + 1.0)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * fl / avgfl)) AS s
  FROM post p JOIN ts USING (t) JOIN len USING (doc_id) CROSS JOIN fs)"""
_TOP = f"{_BM} SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion', 'ble') GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 10"
_ROWS = f"WITH {_LIVE} SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM live"


def rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"))


def top(ix) -> DataFrame:
    return rounded(ix.searcher().search(OR3).rows().select("doc_id", "score"))


register("index_documents", _ROWS)(lambda s, d: rows(index(s, d).docs()))
register("index_optimized_documents", _ROWS)(lambda s, d: rows(optimized(s, d).docs()))
register("index_bm25_top10", _TOP)(lambda s, d: top(index(s, d)))
register("index_optimized_bm25_top10", _TOP)(lambda s, d: top(optimized(s, d)))
register("index_and_or_not", f"{_BM}, a AS (SELECT doc_id FROM bm WHERE t = 'thre' INTERSECT SELECT doc_id FROM bm WHERE t = 'tion') SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE t IN ('thre', 'tion') AND doc_id IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM bm WHERE t = 'ble') GROUP BY doc_id")(
    lambda s, d: rounded(index(s, d).searcher().matches(Q.AndNot(Q.And((T("thre"), T("tion"))), T("ble"))))
)
register("index_phrase", f"{_TOK} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'thre' AND b.t = 'tion' AND b.pos - a.pos BETWEEN 1 AND 4")(lambda s, d: index(s, d).searcher().docs_for_query(Q.Phrase("text", ("thre", "tion"), 4)))
register("index_prefix", f"{_TOK} SELECT DISTINCT doc_id FROM post WHERE starts_with(t, 'renew')")(lambda s, d: index(s, d).searcher().docs_for_query(Q.Prefix("text", "renew")))
register("index_lexicon", f"{_TOK} SELECT t AS term, count(*) AS df, sum(tf)::DOUBLE AS cf, max(tf)::DOUBLE AS max_weight, min(fl)::INTEGER AS min_length, max(fl)::INTEGER AS max_length FROM post JOIN len USING (doc_id) GROUP BY t")(lambda s, d: index(s, d).lexicon("text"))
register("index_postings", f"{_TOK} SELECT doc_id, count(*)::INTEGER AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok WHERE t = 'tion' GROUP BY doc_id")(
    lambda s, d: index(s, d).postings("text", lambda t: t == "tion", True).select("doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))
)
register("index_vectors", f"{_TOK} SELECT doc_id, t AS term, tf::INTEGER AS tf FROM post")(lambda s, d: (lambda c: c.vector("text", positions=False).select("doc_id", "term", "tf"))(index(s, d)))
register("index_field_statistics", f"{_TOK} SELECT n, total::BIGINT AS total_text, round(avgfl, 6) AS avg_text FROM fs")(lambda s, d: index(s, d).field_stats(["text"]).select("n", "total_text", F.round("avg_text", 6).alias("avg_text")))
register("index_lengths", f"{_TOK} SELECT live.doc_id, coalesce(fl, 0)::INTEGER AS length FROM live LEFT JOIN len USING (doc_id)")(lambda s, d: index(s, d).lengths("text"))
register("index_filter_sorted", f"{_TOK} SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id)::INTEGER AS rank FROM live WHERE lang = 'de' AND doc_id IN (SELECT doc_id FROM post WHERE t = 'tion') ORDER BY rank LIMIT 40")(lambda s, d: index(s, d).searcher().search(T("tion"), limit=40, filter=Q.Term("lang", "de"), sortedby="n_chars").rows().select("doc_id", "rank"))
register("index_facets", f"{_TOK} SELECT lang AS key, count(*) AS n FROM live WHERE doc_id IN (SELECT doc_id FROM post WHERE t = 'tion') GROUP BY lang")(lambda s, d: index(s, d).searcher().search(T("tion"), groupedby={"g": "lang"}, maptype=fc.Count).groups("g"))
register("index_most_distinctive", f"{_TOK} SELECT t AS term, round(cf * ln(n::DOUBLE / df), 6) AS score FROM ts CROSS JOIN fs ORDER BY cf * ln(n::DOUBLE / df) DESC, t LIMIT 20")(lambda s, d: index(s, d).most_distinctive_terms("text", 20).select("term", F.round("score", 6).alias("score")))
register("index_counts", f"WITH {_LIVE} SELECT (SELECT count(*) FROM live) AS live, (SELECT count(*) FROM documents) + (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) AS written")(lambda s, d: index(s, d).docs().agg(F.count(F.lit(1)).alias("live")).withColumn("written", F.lit(index(s, d).doc_count_all())))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name", "s_nationkey")


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in an index; those of even nations replaced by name with new identifiers, some then deleted, one in seven."""
    def build(path: str) -> None:
        ix = create_in(spark, path, Schema(s_name=ID(unique=True, stored=True), s_nationkey=NUMERIC()))
        w = ix.writer()
        w.add_documents(suppliers(spark, d))
        w.commit()
        w = ix.writer()
        w.update_documents(suppliers(spark, d).where("s_nationkey % 2 = 0").withColumns({"doc_id": F.col("doc_id") + 1_000_000, "s_nationkey": F.col("s_nationkey") + 100}))
        w.commit()
        ix.delete_by_query(Q.ColumnQuery("doc_id", lambda c: c % 7 == 3))

    return open_dir(spark, once(spark, d, "suppliers", build), Schema(s_name=ID(unique=True, stored=True), s_nationkey=NUMERIC())).docs()


register("upsert_result", "SELECT doc_id, s_name, s_nationkey FROM (SELECT CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS doc_id, s_name, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey FROM supplier) WHERE doc_id % 7 <> 3")(_upserted)


def _writers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers through a queue that another writer overtakes, a buffer, a cancelled writer, a merge of small segments, an
    added reader and an added column."""
    def build(path: str) -> None:
        own = suppliers(spark, d)
        ix = create_in(spark, path, Schema(s_name=ID(), s_nationkey=NUMERIC()))
        queue = QueuedWriter(ix)
        queue.add_documents(own.where("doc_id % 4 = 0"))
        first = ix.refresh().writer()
        first.add_documents(own.where("doc_id % 4 = 1"))
        first.commit()
        queue.commit()
        with BufferedWriter(ix, limit=2) as w:
            w.add_documents(own.where("doc_id % 8 = 2"))
            w.delete_documents(own.where("doc_id % 12 = 0"))
            w.add_documents(own.where("doc_id % 8 = 6"))
        lost = ix.refresh().writer()
        lost.add_documents(own)
        lost.cancel()
        other = FrameCorpus(own.where("doc_id % 4 = 3"), ix.schema)
        w = ix.refresh().writer()
        w.add_reader(other)
        w.commit(merge_below=10_000_000, fan=2)
        add_sortable(ix.refresh(), "last", F.right("s_name", F.lit(2)))

    return open_dir(spark, once(spark, d, "writers", build), Schema(s_name=ID(), s_nationkey=NUMERIC())).docs().select("doc_id", "s_name", "last")


register("index_writers", "SELECT s_suppkey AS doc_id, s_name, right(s_name, 2) AS last FROM supplier WHERE s_suppkey % 12 <> 0")(_writers)


def _cleared(spark: SparkSession, d: str) -> DataFrame:
    def build(path: str) -> None:
        copy_to(spark, index(spark, d).path, path)
        w = open_dir(spark, path, schema()).writer()
        w.add_documents(documents(spark, d).where("lang = 'fr'"))
        w.commit(clear=True)

    return rows(open_dir(spark, once(spark, d, "cleared", build), schema()).docs())


register("index_cleared", "SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM documents WHERE lang = 'fr'")(_cleared)
_BOTH = "live AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'tion laid over' FROM documents WHERE doc_id % 3 = 0)"


def _together(spark: SparkSession, d: str) -> Together:
    docs = documents(spark, d)
    return Together([FrameCorpus(docs, schema()), FrameCorpus(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("tion laid over")), schema())], overlay=True)


register("overlaid_bm25", f"WITH {_BOTH}, {tokens_sql('live')} SELECT doc_id, round((ln(n / (df + 1.0)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * fl / avgfl)), 6) AS score FROM post JOIN ts USING (t) JOIN len USING (doc_id) CROSS JOIN fs WHERE t = 'tion'")(lambda s, d: rounded(_together(s, d).searcher().matches(T("tion"))))


def _streamed(spark: SparkSession, d: str) -> Index:
    """Documents from a stream of three folders, the last of which replaces some of the first."""
    def build(path: str) -> None:
        source, docs = new_path(spark, "stream"), documents(spark, d)
        for k, part in enumerate((docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), docs.where("doc_id % 10 = 4").withColumn("text", F.lit("tion streamed anew")))):
            part.write.mode("append").parquet(f"{source}/{k}")
        ix = create_in(spark, path, schema())
        for k in range(3):
            stream_into(ix, spark.readStream.schema(docs.schema).parquet(f"{source}/{k}"), f"{path}-checkpoint-{k}", optimize_every=2).awaitTermination()

    return open_dir(spark, once(spark, d, "streamed", build), schema())


_STREAM = "live AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'tion streamed anew' ELSE text END AS text, lang, source, n_chars FROM documents)"
register("streamed_documents", f"WITH {_STREAM} SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM live")(lambda s, d: rows(_streamed(s, d).docs()))
register("streamed_phrase", f"WITH {_STREAM}, {tokens_sql('live')} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = 'tion' AND b.t = 'streamed' AND b.pos - a.pos = 1")(lambda s, d: _streamed(s, d).searcher().docs_for_query(Q.Phrase("text", ("tion", "streamed"))))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    def build(path: str) -> None:
        events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
        source = new_path(spark, "events")
        events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        counts_by_window(stream, ["event_type"], "ts", "1 hour", "36500 days", path, f"{path}-checkpoint").awaitTermination()

    path = once(spark, d, "windows", build)
    return latest(spark.read.parquet(path), ["event_type"]).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


register("events_by_window", "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY 1, 2")(_windows)

