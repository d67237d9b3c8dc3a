"""Key terms of documents, documents like others, similarity hashes, and one-dimensional clustering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators import query as Q
from wordloom.sources.corpus import Corpus


def _log2(x: Column) -> Column:
    return F.log2(x)


def bo1(top: Column, collection: Column, top_total: Column, n: Column, total: Column) -> Column:
    f = collection / n
    return top * _log2((1.0 + f) / f) + _log2(1.0 + f)


def bo2(top: Column, collection: Column, top_total: Column, n: Column, total: Column) -> Column:
    f = top * top_total / total
    return top * _log2((1.0 + f) / f) + _log2(1.0 + f)


def kl(top: Column, collection: Column, top_total: Column, n: Column, total: Column) -> Column:
    share = top / top_total
    return F.when(share < collection / total, F.lit(0.0)).otherwise(share * _log2(share / (top / total)))


MODELS = {"bo1": bo1, "bo2": bo2, "kl": kl}


#: Up to so many terms of the documents at hand are told to the scan; more meet it by a join.
LISTED = 10_000


def _ranked(corpus: Corpus, own: DataFrame, field: str, numterms: int, model: str) -> DataFrame:
    """own (term, top): the weights of terms in the documents at hand."""
    listed = own.limit(LISTED + 1).collect()
    if len(listed) <= LISTED and corpus.kind(field).scorable:
        # the few documents' terms are told to the scan, which gives the statistics as well
        own, names = corpus.spark.createDataFrame(listed, own.schema), [r["term"] for r in listed]
        every, stats = corpus.matched(field, lambda t: t.isin(names))
    else:
        every, stats = corpus.postings(field).join(own.select("term"), "term", "left_semi"), corpus.field_stats([field])
    every = every.groupBy("term").agg(F.sum("weight").alias("cf"))
    top_total = own.agg(F.sum("top").alias("top_total"))
    rows = own.join(every, "term").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(top_total))  # a row each
    score = MODELS[model](F.col("top"), F.col("cf"), F.col("top_total"), F.col("n"), F.col(f"total_{field}"))
    rows = rows.select("term", score.alias("raw")).where(F.col("raw") > 0)
    best = rows.orderBy(F.desc("raw"), "term").limit(numterms)
    return best.select("term", (F.col("raw") / F.max("raw").over(Window.partitionBy())).alias("score"))


def key_terms(corpus: Corpus, ids: DataFrame, field: str, numterms: int = 5, model: str = "bo1") -> DataFrame:
    """(term, score) of the terms that tell some documents (a frame with doc_id) from the rest; the best one scores 1."""
    own = corpus.vector(field, ids).groupBy("term").agg(F.sum("weight").alias("top"))
    return _ranked(corpus, own, field, numterms, model)


def key_terms_from_text(corpus: Corpus, field: str, text: str, numterms: int = 5, model: str = "bo1") -> DataFrame:
    tokens = corpus.kind(field).analyzer.tokens(F.lit(text))
    own = corpus.spark.range(1).select(F.explode(tokens).alias("x")).groupBy(F.col("x.t").alias("term")).agg(F.sum("x.b").alias("top"))
    return _ranked(corpus, own, field, numterms, model)


def more_like_query(corpus: Corpus, doc_id: int, field: str, text: str | None = None, numterms: int = 5, model: str = "bo1") -> Q.Query:
    if text is not None:
        terms = key_terms_from_text(corpus, field, text, numterms, model)
    else:
        terms = key_terms(corpus, corpus.docs().where(F.col("doc_id") == doc_id).select("doc_id"), field, numterms, model)
    return Q.Or(tuple(Q.Term(field, r["term"], r["score"]) for r in terms.collect()))  # numterms rows


def shingles(text: Column, size: int = 2) -> Column:
    """Character shingles, repeated ones too."""
    n = F.length(text) - size + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def md5_hash(x: Column) -> Column:
    """The first 64 bits of a string's MD5, as other systems have them too."""
    return F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("bigint")


#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 17


def _majority(c: pa.Array) -> pa.Array:
    """The bits that most hashes of each list have."""
    sizes = pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    flat = c.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    ones, owner = np.zeros((len(sizes), 64), "int32"), np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(flat), AT_ONCE):
        own = owner[a : a + AT_ONCE]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(flat[a : a + AT_ONCE].astype("<i8").view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        ones[own[start]] += np.add.reduceat(bits, start, axis=0, dtype="int32")
    most = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").reshape(-1).view("<i8")
    return pa.array(most, mask=c.is_null().to_numpy(zero_copy_only=False))


def simhash(features: Column, weights: Column | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """64-bit simhash of an array of strings: each bit is what most of the weight has. Without weights bits are counted in
    Arrow batches; with them it is one fold over 64 sums."""
    hashes = F.transform(features, lambda x: hashed(x))
    if weights is None:
        return F.arrow_udf(_majority, "bigint")(hashes)
    both = F.zip_with(hashes, weights, lambda h, x: F.struct(h.alias("h"), x.cast("double").alias("w")))
    sums = F.aggregate(both, F.array_repeat(F.lit(0.0), 64), lambda acc, x: F.transform(acc, lambda v, i: v + F.when(F.getbit(x["h"], i) == 1, x["w"]).otherwise(-x["w"])))
    powers = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    return F.aggregate(F.zip_with(sums, powers, lambda v, p: F.when(v > 0, p).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, p: acc.bitwiseOR(p))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def kmeans(df: DataFrame, value: str, k: int, centers: list[float] | None = None, t: float = 1e-4, maxiter: int = 50) -> DataFrame:
    """df with `cluster`, the nearest of k centres of a number column; the first centres are even quantiles."""
    c = centers or df.approxQuantile(value, [(i + 0.5) / k for i in range(k)], 0.001)
    for _ in range(maxiter):
        at = _nearest(F.col(value), c)
        got = {r["i"]: r["m"] for r in df.where(F.col(value).isNotNull()).groupBy(at.alias("i")).agg(F.avg(value).alias("m")).collect()}  # k rows
        new = [got.get(i, x) for i, x in enumerate(c)]
        moved = max(abs(a - b) for a, b in zip(c, new))
        c = new
        if moved <= t:
            break
    return df.withColumn("cluster", _nearest(F.col(value), c))


def _nearest(x: Column, centers: list[float]) -> Column:
    options = F.array(*(F.struct(F.abs(x - m).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centers)))
    return F.array_min(options)["i"]


def variance(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """Sample variance, weighted or not: sum of squared deviations over total weight minus 1."""
    if weight is None:
        return df.agg(F.var_samp(value).alias("variance"))
    w, x = F.col(weight), F.col(value)
    mean = df.agg((F.sum(w * x) / F.sum(w)).alias("mean"))
    return df.crossJoin(F.broadcast(mean)).agg((F.sum(w * (x - F.col("mean")) ** 2) / (F.sum(w) - 1)).alias("variance"))


def swin(df: DataFrame, value: str, size: float, partition: str | None = None) -> DataFrame:
    """(start, stop, n) for every different value, by partition if one is given: the window from it on, the last value within
    size, and how many rows lie in between.

    Equal values are counted first; the values are dealt to buckets of the window's size, each of which also gets those of
    the next, so that no task sees more than two buckets.
    """
    keys = [partition] if partition else []
    x = F.col(value)
    one = df.where(x.isNotNull()).groupBy(*keys, x.alias("start")).agg(F.count(F.lit(1)).alias("k"))
    own = F.floor(F.col("start") / size) if size > 0 else F.col("start")
    dealt = one.withColumn("own", own).withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") - 1) if size > 0 else F.array("own")))
    near = Window.partitionBy(*keys, "bucket").orderBy("start").rangeBetween(0, size)
    counted = dealt.withColumns({"stop": F.max("start").over(near), "n": F.sum("k").over(near)})
    return counted.where(F.col("bucket") == F.col("own")).select(*keys, "start", "stop", "n")
