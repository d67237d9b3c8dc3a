"""Parents and children: documents of a group in order, each parent before its children.

The documents have group_id and seq_in_group columns; a child belongs to the nearest parent before it in its group, so
that everything happens within a group's rows and no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators import query as Q
from wordloom.operators.compile import compiled, last_parent
from wordloom.operators.scoring import Weighting
from wordloom.sources.corpus import Corpus

COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}


def _owners(corpus: Corpus, parents: Q.Query) -> DataFrame:
    """(doc_id, owner, is_parent) of every document that has a parent or is one."""
    flags = compiled(parents, corpus, scored=False).select("doc_id", F.lit(True).alias("is_parent"))
    rows = corpus.docs().select("doc_id", "group_id", "seq_in_group").join(flags, "doc_id", "left")
    rows = rows.withColumn("is_parent", F.coalesce("is_parent", F.lit(False)))
    return rows.withColumn("owner", last_parent("seq_in_group", F.col("is_parent"))).where("owner is not null").select("doc_id", "owner", "is_parent")


def parents_of(corpus: Corpus, q: Q.NestedParent, w: Weighting) -> DataFrame:
    hits = compiled(q.query, corpus, w).join(_owners(corpus, q.parents).where(~F.col("is_parent")), "doc_id")
    if q.per_parent_limit is not None:
        rank = F.row_number().over(Window.partitionBy("owner").orderBy("doc_id"))
        hits = hits.withColumn("n", rank).where(F.col("n") <= q.per_parent_limit)
    return hits.groupBy(F.col("owner").alias("doc_id")).agg(COMBINE[q.combine]("score").alias("score"))


def children_of(corpus: Corpus, q: Q.NestedChildren, w: Weighting) -> DataFrame:
    hits = compiled(q.query, corpus, w).select(F.col("doc_id").alias("owner"), "score")
    return _owners(corpus, q.parents).where(~F.col("is_parent")).join(hits, "owner").select("doc_id", F.lit(1.0).alias("score"))


def deletion_docs(corpus: Corpus, q: Q.NestedParent) -> DataFrame:
    """The parents that q finds and everything that belongs to them."""
    hits = compiled(q, corpus).select(F.col("doc_id").alias("owner"))
    return _owners(corpus, q.parents).join(hits, "owner", "left_semi").select("doc_id")
