"""Synonyms from WordNet's Prolog file of senses: lines such as s(100001740,1,'entity',n,1,11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import query as Q
from wordloom.sources.scratch import kept


def parse_file(spark: SparkSession, path: str) -> DataFrame:
    """(synset, word): words in lower case, each synset's once; lines of other kinds are left out."""
    line = F.col("value")
    word = F.regexp_replace(F.regexp_extract(line, r"^s\(\d+,\d+,'((?:[^']|'')+)',", 1), "''", "'")
    rows = spark.read.text(path).select(F.regexp_extract(line, r"^s\((\d+),", 1).try_cast("bigint").alias("synset"), F.lower(word).alias("word"))
    return rows.where("synset is not null and word <> ''").distinct()


class Thesaurus:
    """Words by synset, as a table."""

    def __init__(self, senses: DataFrame):
        self.senses = senses

    @staticmethod
    def from_file(spark: SparkSession, path: str) -> Thesaurus:
        return Thesaurus(parse_file(spark, path))

    def saved(self, path: str | None = None) -> Thesaurus:
        """The table written down, sorted by word so that a lookup reads few row groups."""
        rows = self.senses.repartitionByRange("word").sortWithinPartitions("word")
        if path is None:
            return Thesaurus(kept(rows, "senses"))
        rows.write.parquet(path)
        return Thesaurus(rows.sparkSession.read.parquet(path))

    def pairs(self) -> DataFrame:
        """(word, synonym) of all different words that share a synset."""
        a, b = self.senses, self.senses.withColumnRenamed("word", "synonym")
        return a.join(b, "synset").where("word <> synonym").select("word", "synonym").distinct()

    def synonyms(self, word: str) -> list[str]:
        """Other words of the word's synsets, sorted."""
        own = self.senses.where(F.col("word") == word.lower()).select("synset")
        rows = self.senses.join(own, "synset", "left_semi").where(F.col("word") != word.lower()).select("word").distinct()
        return [r["word"] for r in rows.orderBy("word").collect()]  # a word's few synsets

    def expand(self, q: Q.Query, boost: float = 0.5) -> Q.Query:
        """Every term with its synonyms beside it, at a share of its boost."""
        def one(x: Q.Query) -> Q.Query:
            if isinstance(x, Q.Term) and (more := self.synonyms(x.text)):
                return Q.Or((x, *(Q.Term(x.field, w, x.boost * boost) for w in more)))
            return x

        return q.accept(one)
