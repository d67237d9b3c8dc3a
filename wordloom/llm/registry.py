"""The corpus operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, html_content, minhash, nn_descent, pii, rans, sharding, sql, toxicity, transducer
from wordloom.llm import token_counts as token_counts_module
from wordloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op2_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_documents(table(spark, sf_dir, "documents"))


def op3_dom_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_content.extract(pages, html_content.train(pages))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts_module.token_counts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as text, blanks between them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = transducer.encode_documents(docs)
    return made.select("doc_id", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("token_ids"), "n_tokens", "round_trip")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_karmarkar_karp_shards": op1_karmarkar_karp_shards,
        "op2_rans_blocks": op2_rans_blocks,
        "op3_dom_content": op3_dom_content,
        "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity,
        "op6_bootstrapped_pii": op6_bootstrapped_pii,
        "op7_cgk_decontamination": op7_cgk_decontamination,
        "op8_bpe_transducer": op8_bpe_transducer,
        "op9_nn_descent": op9_nn_descent,
        "op10_probminhash": op10_probminhash,
    }


def oracle_sql() -> dict[str, str]:
    """By SQL's own ways; the other operators' results are tested against brute force."""
    return dict(sql.ORACLE)
