"""Searching: ranked, sorted, filtered, collapsed, grouped and paged results of a query over a corpus."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators import query as Q
from wordloom.operators.compile import compiled
from wordloom.operators.facets import Count, Facet, facet, facets, grouped
from wordloom.operators.scoring import BM25F, FunctionWeighting, Stats, Weighting, idf
from wordloom.sources.corpus import Corpus, term_info
from wordloom.sources.scratch import kept as kept_table
from wordloom.sources.scratch import new_path


class TimeLimit(Exception):
    """A search took longer than it was given."""


class NoTermsException(Exception):
    """Matched terms were asked for that weren't recorded."""


class Results:
    """rows(): doc_id, score, rank of what is kept; everything else is computed when asked for.

    The hits of a search without a limit come in order but with a null rank: numbering them takes a pass of its own, which
    ranked() does.
    """

    def __init__(self, searcher: Searcher, q: Q.Query, every: DataFrame, kept: DataFrame, groups: dict[str, Facet], kind: Callable, terms: bool, collapsed: DataFrame | None = None, unlimited: bool = False):
        self.unlimited = unlimited
        self.searcher, self.q, self.every, self.kept, self.facets, self.kind, self.terms, self.collapsed = searcher, q, every, kept, groups, kind, terms, collapsed

    def rows(self) -> DataFrame:
        return self.kept.withColumn("rank", F.lit(None).cast("int")) if self.unlimited else self.kept

    def ranked(self) -> DataFrame:
        """rows() with ranks from 1 on without gaps, whatever their number: the hits are written in order, and each part's
        rows counted, so that no task sees all of them."""
        if not self.unlimited:
            return self.kept
        path = new_path(self.searcher.corpus.spark, "ranked")
        self.kept.drop("rank").write.parquet(path)
        rows = self.searcher.corpus.spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # a row a file
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.join(F.broadcast(sizes.select("_file", before.alias("_before"))), "_file").withColumn("rank", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")

    def docs(self) -> DataFrame:
        """doc_ids of all matches, kept or not."""
        return self.every.select("doc_id")

    def total(self) -> int:
        """How many documents match, kept or not."""
        return self.every.count()

    estimated_length = total

    def scored_length(self) -> int:
        return self.kept.count()

    def fields(self, *names: str) -> DataFrame:
        """The kept hits with their stored columns, best first."""
        docs = self.searcher.corpus.docs().select("doc_id", *names)
        return self.kept.join(docs, "doc_id").orderBy("rank")

    def groups(self, name: str | None = None, kind: Callable | None = None) -> DataFrame:
        by = self.facets[name] if name else next(iter(self.facets.values()))
        rows = self.every.join(self.searcher.corpus.docs(), "doc_id")
        return grouped(rows, by, self.searcher.corpus, kind or self.kind)

    def collapsed_counts(self) -> DataFrame:
        """(key, n): how many hits each key lost to collapsing."""
        if self.collapsed is None:
            raise ValueError("the search didn't collapse")
        return self.collapsed

    def matched_terms(self) -> DataFrame:
        """(doc_id, matched) of the kept hits."""
        if not self.terms:
            raise NoTermsException("search with terms=True")
        return self.kept.select("doc_id", "matched")

    def _renewed(self, kept: DataFrame) -> Results:
        return Results(self.searcher, self.q, self.every, kept, self.facets, self.kind, self.terms, self.collapsed)

    def estimated_min_length(self) -> int:
        """At least so many documents match: the number itself, as it is counted."""
        return self.total()

    def has_exact_length(self) -> bool:
        return True

    def _ordered(self, rows: DataFrame, *first) -> DataFrame:
        """Few rows by nature (kept hits), ranked anew."""
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*first, "rank")).cast("int"))

    def extend(self, other: Results) -> Results:
        """Hits of the other that aren't here follow those here."""
        more = other.kept.join(self.kept.select("doc_id"), "doc_id", "left_anti").withColumn("part", F.lit(1))
        both = self.kept.withColumn("part", F.lit(0)).unionByName(more, allowMissingColumns=True)
        return self._renewed(self._ordered(both, "part").drop("part"))

    def filter(self, other: Results) -> Results:
        """Only hits that the other has too."""
        return self._renewed(self._ordered(self.kept.join(other.docs(), "doc_id", "left_semi")))

    def upgrade(self, other: Results, reverse: bool = False) -> Results:
        """Hits that the other has too come first, or last."""
        mark = other.docs().distinct().select("doc_id", F.lit(0 if not reverse else 1).alias("part"))
        both = self.kept.join(mark, "doc_id", "left").withColumn("part", F.coalesce("part", F.lit(1 if not reverse else 0)))
        return self._renewed(self._ordered(both, "part").drop("part"))

    def upgrade_and_extend(self, other: Results) -> Results:
        return self.upgrade(other).extend(other)

    def key_terms(self, field: str, docs: int = 10, numterms: int = 5, model: str = "bo1") -> DataFrame:
        from wordloom.operators.classify import key_terms

        return key_terms(self.searcher.corpus, self.kept.where(F.col("rank") <= docs), field, numterms, model)


class Searcher:
    def __init__(self, corpus: Corpus, weighting: Weighting | None = None):
        self.corpus, self.weighting = corpus, weighting or BM25F()

    def matches(self, q: Q.Query, scored: bool = True, matched: bool = False) -> DataFrame:
        return compiled(q, self.corpus, self.weighting, scored, matched=matched)

    def docs_for_query(self, q: Q.Query, for_deletion: bool = False) -> DataFrame:
        from wordloom.operators.nested import deletion_docs

        if for_deletion and isinstance(q, Q.NestedParent):
            return deletion_docs(self.corpus, q)
        return self.matches(q, scored=False).select("doc_id")

    def search(self, q: Q.Query, limit: int | None = 10, scored: bool = True, sortedby: Any = None, reverse: bool = False, groupedby: Any = None, collapse: Any = None, collapse_limit: int = 1, collapse_order: Any = None, filter: Any = None, mask: Any = None, terms: bool = False, maptype: Callable = Count, keep: bool = False) -> Results:
        """filter and mask: a query, Results or a DataFrame with doc_id that hits have to be in, or mustn't. Ties go by doc_id.
        keep: write the matches down, so that all that is asked of them reads the corpus once."""
        hits = self.matches(q, scored, terms)
        for allowed, how in ((filter, "left_semi"), (mask, "left_anti")):
            if allowed is not None:
                hits = hits.join(self._ids(allowed), "doc_id", how)
        if keep:
            hits = kept_table(hits)
        sort = facet(sortedby) if sortedby is not None else None
        rows, columns = hits, list(hits.columns)
        by = facet(collapse) if collapse is not None else None
        best = facet(collapse_order) if collapse_order is not None else None
        needed = [f for f in (sort, by, best) if f is not None]
        if needed:
            rows = hits.join(self.corpus.docs(), "doc_id")
            for f in needed:
                rows = f.prepare(rows, self.corpus)
        order = sort.order(reverse) if sort else [F.col("score").asc() if reverse else F.col("score").desc()]
        order.append(F.col("doc_id").desc() if reverse else F.col("doc_id").asc())
        lost = None
        if by is not None:
            key = by.key()
            empty = key.isNull() | (key.cast("string") == "")
            inner = [*(best.order() if best else order[:-1]), F.col("doc_id").asc()]
            n = F.when(empty, F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(key).orderBy(*inner)))
            numbered = rows.withColumn("_n", n)
            lost = numbered.where(F.col("_n") > collapse_limit).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
            rows = numbered.where(F.col("_n") <= collapse_limit)
            hits = rows.select(*columns)
        if limit is not None:
            top = rows.orderBy(*order).limit(limit)  # a heap of `limit` rows a task
            kept = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
        else:
            kept = rows.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())
        return Results(self, q, hits.select(*columns), kept.select(*columns, "rank"), facets(groupedby) if groupedby is not None else {}, maptype, terms, lost, limit is None)

    def collector(self, limit: int | None = 10, **how) -> Callable[[Q.Query], Results]:
        """A search with its settings made, to be run with one query after the other."""
        return lambda q: self.search(q, limit=limit, **how)

    def search_with_collector(self, q: Q.Query, collect: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What a function of the scored matches (doc_id, score) gives: a way to collect that search() doesn't have."""
        return collect(self.matches(q))

    def context(self, weighting: Weighting | None = None) -> Searcher:
        """A searcher of the same corpus with another model."""
        return Searcher(self.corpus, weighting or self.weighting)

    def boolean_context(self) -> Searcher:
        """A searcher that counts every match as 1."""
        return Searcher(self.corpus, FunctionWeighting(lambda s: F.lit(1.0)))

    def _ids(self, x: Any) -> DataFrame:
        if isinstance(x, Q.Query):
            return self.docs_for_query(x)
        return (x.docs() if isinstance(x, Results) else x).select("doc_id")

    def search_page(self, q: Q.Query, pagenum: int, pagelen: int = 10, **how) -> Results:
        """One page; a number beyond the last page gives the last one."""
        if pagenum < 1:
            raise ValueError("pages are numbered from 1")
        found = self.search(q, limit=pagenum * pagelen, keep=True, **how)  # the total and the page from one pass
        total = found.total()
        last = max(1, -(-total // pagelen))
        first = (min(pagenum, last) - 1) * pagelen
        return found._renewed(found.kept.where((F.col("rank") > first) & (F.col("rank") <= first + pagelen)))

    def find(self, field: str, text: str, **how) -> Results:
        from wordloom.plans.parser import QueryParser

        return self.search(QueryParser(field, self.corpus.schema, self.corpus.spark).parse(text), **how)

    def timed(self, q: Q.Query, seconds: float, **how) -> list:
        """The kept rows, or TimeLimit: the job is cancelled when its time is over."""
        import threading

        sc = self.corpus.spark.sparkContext
        tag = f"search-{time.time_ns()}"
        timer = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
        sc.addJobTag(tag)
        timer.start()
        began = time.monotonic()
        try:
            return self.search(q, **how).rows().collect()
        except Exception as e:
            if time.monotonic() - began >= seconds:
                raise TimeLimit(f"longer than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def documents(self, **values) -> DataFrame:
        return self.corpus.docs().join(self.corpus.document_ids(**values), "doc_id", "left_semi") if values else self.corpus.docs()

    def document(self, **values) -> dict | None:
        r = self.documents(**values).orderBy("doc_id").first()
        return r.asDict() if r else None

    def postings(self, field: str, text: str, weighting: Weighting | None = None) -> DataFrame:
        return compiled(Q.Term(field, text), self.corpus, weighting or self.weighting)

    def idf(self, field: str, text: str) -> float:
        info = term_info(self.corpus.postings(field, lambda t: t == text))
        n = self.corpus.field_stats([]).first()["n"]
        df = (info.first() or {"df": 0})["df"]
        import math

        return math.log(n / (df + 1)) + 1

    def avg_field_length(self, field: str) -> float:
        return self.corpus.field_stats([field]).first()[f"avg_{field}"]

    def suggest(self, field: str, text: str, limit: int = 5, maxdist: int = 2, prefix: int = 0) -> list[str]:
        from wordloom.operators.spelling import suggestions

        return [r["term"] for r in suggestions(self.corpus, field, text, limit, maxdist, prefix).collect()]

    def key_terms(self, ids: DataFrame, field: str, numterms: int = 5, model: str = "bo1") -> DataFrame:
        from wordloom.operators.classify import key_terms

        return key_terms(self.corpus, ids, field, numterms, model)

    def more_like(self, doc_id: int, field: str, text: str | None = None, top: int = 10, numterms: int = 5, model: str = "bo1") -> Results:
        from wordloom.operators.classify import more_like_query

        q = more_like_query(self.corpus, doc_id, field, text, numterms, model)
        mask = self.corpus.docs().where(F.col("doc_id") == doc_id).select("doc_id")
        return self.search(q, limit=top, mask=mask)


__all__ = ["NoTermsException", "Results", "Searcher", "Stats", "TimeLimit", "idf"]
