"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next.

toxicity drops documents that a model trained on `labels` rejects; minhash keeps one document of each group of near-
duplicates; decontamination drops documents that hold a passage of `benchmark`; pii replaces identifiers by their kind's
name in the text (n_chars follows it); bpe adds token_ids, n_tokens and round_trip. All stages but the last return the
columns of documents. Every stage works on all rows of the one before.

Null texts pass through every stage and have null token_ids; null ids pass, masked and encoded like others; empty texts are
one document each id, of which minhash keeps one; of rows with the same id and text one stays; an id's texts that aren't
alike stay; texts are read whole, however long; of a group the smallest id stays, and a toxicity score at the threshold
goes; other columns, whatever their names, are carried along, and n_chars is set anew where there is one; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, minhash, pii, toxicity, transducer
from wordloom.llm.common import saved, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return transducer.encode_documents(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("minhash", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_identifiers),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs


#: No stage but the counting of copies can be said in SQL.
ORACLE_SQL = None
