"""A corpus: documents, their postings and statistics, from a DataFrame at hand or from an index on disk.

Postings are (field, term, doc_id, tf, weight, length[, positions]). From a DataFrame they are made while it is read, and
only for the terms that a query asks for: a document's tokens are one array, which is filtered and drawn together by term
inside the row, so nothing moves before the matches are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import words
from wordloom.functions.analysis import let
from wordloom.functions.formats import FieldType, Schema
from wordloom.sources.scratch import NoScratchError, kept

Predicate = Callable[[Column], Column]
POSTING = "array<struct<term:string,tf:int,weight:double,positions:array<int>>>"


class Corpus:
    """What the query compiler reads. N and lengths are of the live documents."""

    schema: Schema
    spark: SparkSession

    def docs(self) -> DataFrame:
        """doc_id and the columns of live documents."""
        raise NotImplementedError

    def postings(self, field: str, where: Predicate | None = None, positions: bool = False) -> DataFrame:
        """Live postings of a field, of the terms for which where(term) holds."""
        raise NotImplementedError

    def field_stats(self, fields: list[str]) -> DataFrame:
        """One row: n, and for each field total_<field> and avg_<field>."""
        raise NotImplementedError

    def kind(self, field: str) -> FieldType:
        return self.schema[field]

    # statistics of terms and fields

    def lexicon(self, field: str) -> DataFrame:
        """(term, df, cf, max_weight, min_length, max_length) of every term of a field."""
        return term_info(self.postings(field))

    def terms_with(self, field: str, where: Predicate) -> DataFrame:
        return term_info(self.postings(field, where))

    def most_frequent_terms(self, field: str, number: int = 5, prefix: str = "") -> DataFrame:
        return self._prefixed(field, prefix).orderBy(F.desc("cf"), "term").limit(number).select("term", "cf")

    def _prefixed(self, field: str, prefix: str) -> DataFrame:
        return self.terms_with(field, lambda t: t.startswith(prefix)) if prefix else self.lexicon(field)

    def most_distinctive_terms(self, field: str, number: int = 5, prefix: str = "") -> DataFrame:
        n = self.field_stats([field]).select("n")
        terms = self._prefixed(field, prefix).crossJoin(F.broadcast(n))
        score = F.col("cf") * F.ln(F.col("n") / F.col("df"))
        return terms.select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(number)

    def matched(self, field: str, where: Predicate, positions: bool = False) -> tuple[DataFrame, DataFrame]:
        """Postings of the terms for which where(term) holds, and the field's statistics."""
        return self.postings(field, where, positions), self.field_stats([field] if self.kind(field).scorable else [])

    def vector(self, field: str, ids: DataFrame | None = None, positions: bool = True) -> DataFrame:
        """Postings of some documents (a frame with doc_id) or of all: the forward index."""
        own = self.postings(field, positions=positions and self.kind(field).positions)
        return own if ids is None else own.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def doc_count(self) -> int:
        return self.docs().count()

    def doc_count_all(self) -> int:
        """Documents with those that are deleted and not yet taken out."""
        return self.doc_count()

    def has_deletions(self) -> bool:
        return self.doc_count_all() != self.doc_count()

    def first_id(self, field: str, text: str) -> int | None:
        """The smallest doc_id that has a term; None if no document has it."""
        return self.postings(field, lambda t: t == text).agg(F.min("doc_id")).first()[0]

    def frequency(self, field: str, text: str) -> float:
        r = self.terms_with(field, lambda t: t == text).first()
        return r["cf"] if r else 0.0

    def doc_frequency(self, field: str, text: str) -> int:
        r = self.terms_with(field, lambda t: t == text).first()
        return r["df"] if r else 0

    def has_vector(self, doc_id: int, field: str) -> bool:
        """Whether a document has terms in a field, which can be read by document."""
        own = self.docs().where(F.col("doc_id") == doc_id).select("doc_id")
        return self.kind(field).indexed and not self.vector(field, own).isEmpty()

    def vector_as(self, aspect: str, doc_id: int, field: str) -> DataFrame:
        """(term, value) of one document; aspect: "frequency", "weight" or "positions"."""
        column = {"frequency": "tf", "weight": "weight", "positions": "positions"}[aspect]
        return self.vector(field, self.docs().where(F.col("doc_id") == doc_id).select("doc_id")).select("term", F.col(column).alias("value"))

    def min_field_length(self, field: str) -> int:
        return self.field_lengths(field)["shortest"] or 0

    def max_field_length(self, field: str) -> int:
        return self.field_lengths(field)["longest"] or 0

    def doc_field_length(self, doc_id: int, field: str) -> int:
        r = self.lengths(field).where(F.col("doc_id") == doc_id).first()
        return r["length"] if r else 0

    def lengths(self, field: str) -> DataFrame:
        """(doc_id, length) of every document."""
        raise NotImplementedError

    def field_lengths(self, field: str):
        """The shortest and the longest of the documents that have terms in a field."""
        return self.lengths(field).where("length > 0").agg(F.min("length").alias("shortest"), F.max("length").alias("longest")).first()

    def document_ids(self, **values) -> DataFrame:
        """doc_ids of documents that have all the values, by the field's terms where it is indexed, else by the column."""
        out = self.docs()
        for name, v in values.items():
            out = out.where(F.col(name) == F.lit(v))
        return out.select("doc_id")

    def searcher(self, weighting=None):
        from wordloom.operators.search import Searcher

        return Searcher(self, weighting)


def term_info(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"), F.max("weight").alias("max_weight"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))


def gathered(tokens: Column, where: Predicate | None, boost: float) -> Column:
    """Tokens of one document drawn together by term, in the time that sorting them takes."""
    chosen = tokens if where is None else F.filter(tokens, lambda x: where(x["t"]))
    return let(F.sort_array(F.transform(chosen, lambda x: F.struct(x["t"].alias("t"), x["pos"].alias("pos"), x["b"].alias("b")))), lambda own: let(_edges(own, lambda x: x["t"]), lambda at: _by_term(own, at, boost)))


def _edges(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """Where another key begins in an ordered array, and its size at the end."""
    inner = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
    starts = F.filter(inner, lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, F.greatest(i - 1, F.lit(0))))))
    return F.when(F.size(ordered) > 0, F.concat(starts, F.array(F.size(ordered)))).otherwise(F.array().cast("array<int>"))


def _runs(at: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(start, size) of every run between edges."""
    return F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, i: made(a, F.get(at, i + 1) - a))


def _by_term(own: Column, at: Column, boost: float) -> Column:
    def one(a: Column, n: Column) -> Column:
        return let(F.slice(own, a + 1, n), lambda run: F.struct(
            F.get(own, a)["t"].alias("term"), n.cast("int").alias("tf"), (F.aggregate(run, F.lit(0.0), lambda acc, x: acc + x["b"]) * boost).alias("weight"), F.transform(run, lambda x: x["pos"]).alias("positions"),
        ))

    return _runs(at, one)


def counted_terms(strings: Column, where: Predicate | None) -> Column:
    """array<struct<term, tf>> of an array of strings."""
    chosen = strings if where is None else F.filter(strings, lambda x: where(x))
    runs = lambda own, at: _runs(at, lambda a, n: F.struct(F.get(own, a).alias("term"), n.cast("int").alias("tf")))
    return let(F.sort_array(chosen), lambda own: let(_edges(own, lambda x: x), lambda at: runs(own, at)))


#: Tables up to so many bytes are dealt to all cores before they are analysed, as their few files would keep few busy.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, least: int = 0) -> DataFrame:
    """df over all cores where the optimizer knows it for a small table, of `least` bytes at least; others stay as they are read."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if least <= int(str(size)) <= SPREAD_BYTES else df


class FrameCorpus(Corpus):
    """A corpus over a DataFrame with doc_id; schema names the columns that are searched."""

    def __init__(self, docs: DataFrame, schema: Schema, id_col: str = "doc_id"):
        self.frame = docs if id_col == "doc_id" else docs.withColumnRenamed(id_col, "doc_id")
        self.schema, self.spark = schema, docs.sparkSession

    def docs(self) -> DataFrame:
        return self.frame

    def tokens(self, field: str) -> DataFrame:
        """(doc_id, tokens)."""
        return self.frame.select("doc_id", self.kind(field).analyzer.tokens(F.col(field)).alias("tokens"))

    def postings(self, field: str, where: Predicate | None = None, positions: bool = False) -> DataFrame:
        kind = self.kind(field)
        strings = None if positions else kind.analyzer.strings(F.col(field))
        if strings is not None:
            return self._counted(field, strings, where, kind.field_boost)
        rows = self.tokens(field).withColumn("length", F.size("tokens"))
        p = rows.select("doc_id", "length", F.explode(gathered(F.col("tokens"), where, kind.field_boost)).alias("p"))
        out = p.select(F.lit(field).alias("field"), "p.term", "doc_id", "p.tf", "p.weight", "length", "p.positions")
        return out if positions else out.drop("positions")

    def _counted(self, field: str, strings: Column, where: Predicate | None, boost: float) -> DataFrame:
        """Postings without positions: terms and how often each stands, from strings alone."""
        rows = self.frame.select("doc_id", strings.alias("x")).withColumn("length", F.size("x"))
        p = rows.select("doc_id", "length", F.explode(counted_terms(F.col("x"), where)).alias("p"))
        out = p.select("doc_id", "p.term", "p.tf", "length")
        return out.select(F.lit(field).alias("field"), "term", "doc_id", "tf", (F.col("tf") * F.lit(float(boost))).alias("weight"), "length")

    def lengths(self, field: str) -> DataFrame:
        return self.frame.select("doc_id", self.kind(field).analyzer.size(F.col(field)).alias("length"))

    def matched(self, field: str, where: Predicate, positions: bool = False) -> tuple[DataFrame, DataFrame]:
        """The texts are analysed once: each document's length and chosen postings are written and read back."""
        kind = self.kind(field)
        plain = kind.analyzer.plain()
        strings = None if positions else kind.analyzer.strings(F.col(field)) if plain is None else words.strings(F.col(field), words.letters(self.spark), *plain)
        x = kind.analyzer.tokens(F.col(field)) if strings is None else strings
        m = gathered(F.col("x"), where, kind.field_boost) if strings is None else counted_terms(F.col("x"), where)
        rows = self.frame.select("doc_id", x.alias("x")).select("doc_id", F.size("x").alias("length"), m.alias("m"))
        try:
            rows = kept(rows, "matched")
        except NoScratchError:
            return super().matched(field, where, positions)
        p = rows.select("doc_id", "length", F.explode("m").alias("p"))
        weight = F.col("p.weight") if strings is None else F.col("p.tf") * F.lit(float(kind.field_boost))
        out = p.select(F.lit(field).alias("field"), "p.term", "doc_id", "p.tf", weight.alias("weight"), "length", *(["p.positions"] if positions else []))
        return out, summed(rows, {field: "length"} if kind.scorable else {})

    def vector(self, field: str, ids: DataFrame | None = None, positions: bool = True) -> DataFrame:
        own = self if ids is None else FrameCorpus(self.frame.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), self.schema)
        return own.postings(field, positions=positions and self.kind(field).positions)

    def field_stats(self, fields: list[str]) -> DataFrame:
        sizes = self.frame.select(*(self.kind(f).analyzer.size(F.col(f)).alias(f) for f in fields)) if fields else self.frame.select("doc_id")
        return summed(sizes, {f: f for f in fields})


def summed(lengths: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of n, total_<field> and avg_<field> from columns of lengths."""
    total = lengths.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{f}") for f, c in columns.items()))
    avg = [F.when((F.col("n") > 0) & (F.col(f"total_{f}") > 0), F.col(f"total_{f}") / F.col("n")).otherwise(F.lit(1.0)).alias(f"avg_{f}") for f in columns]
    return total.select("*", *avg)
