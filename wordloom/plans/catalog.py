"""Registered queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.functions.analysis import STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
WORD = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"


def tokens_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs of the standard analysis: tok (doc_id, t, pos), len, fs, post, ts."""
    return f"""raw AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM (SELECT {key} AS doc_id, regexp_extract_all(lower({text}), '{WORD}') AS l FROM {table})),
kept AS (SELECT * FROM raw WHERE length(t) >= 2 AND t NOT IN ({_STOP})),
tok AS (SELECT doc_id, t, min(i) OVER (PARTITION BY doc_id) + row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM kept),
len AS (SELECT doc_id, count(*) AS fl FROM tok GROUP BY doc_id),
fs AS (SELECT (SELECT count(*) FROM {table}) AS n, sum(fl) AS total, sum(fl)::DOUBLE / (SELECT count(*) FROM {table}) AS avgfl FROM len),
post AS (SELECT t, doc_id, count(*) AS tf FROM tok GROUP BY t, doc_id),
ts AS (SELECT t, count(*) AS df, sum(tf) AS cf FROM post GROUP BY t)"""


TOK = tokens_sql()
#: bm (t, doc_id, s): BM25 scores of all postings.
BM25 = TOK + """,
bm AS (SELECT p.t, p.doc_id, (ln(n / (df + 1.0)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * fl / avgfl)) AS s
  FROM post p JOIN ts USING (t) JOIN len USING (doc_id) CROSS JOIN fs)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def load() -> None:
    """Fill the registry; the modules of queries import this one."""
    from wordloom.plans import catalog_analysis, catalog_features, catalog_index, catalog_search  # noqa: F401

