"""Documents from a stream into an index, searchable after every micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.sources.index import Index, open_dir


def stream_into(index: Index, stream: DataFrame, checkpoint: str, period: str | None = None, update: bool = True, optimize_every: int = 50) -> StreamingQuery:
    """Each micro-batch becomes a segment: with update, rows replace documents of the same unique values or doc_id.

    Without a period what is there is taken and the stream ends. A batch that ran before a failure is recognised by its
    documents' ids and replaces itself. Every optimize_every batches the segments are folded together.
    """

    def batch(df: DataFrame, number: int) -> None:
        ix = open_dir(df.sparkSession, index.path, index.schema)
        w = ix.writer()
        (w.update_documents if update else w.add_documents)(df)
        w.commit(optimize=optimize_every > 0 and (number + 1) % optimize_every == 0)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=period) if period else q.trigger(availableNow=True)).start()


def counts_by_window(stream: DataFrame, keys: list[str], ts: str, width: str, late: str, path: str, checkpoint: str, value: Column | None = None) -> StreamingQuery:
    """Counts (or sums of a value) by keys and windows of a stream with late rows, taken as far as the stream goes.

    Each micro-batch writes the windows that it changed with its number, under path; latest() reads the last state of each.
    Rows later than `late` behind the newest are left out, which bounds the state.
    """
    n = F.count(F.lit(1)) if value is None else F.sum(value)
    counted = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(n.alias("n"))

    def batch(df: DataFrame, number: int) -> None:
        df.select(*keys, F.col("w.start").alias("start"), "n").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counted.writeStream.outputMode("update").foreachBatch(lambda df, number: batch(df, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that counts_by_window wrote, the last for each key and window."""
    return df.groupBy(*keys, "start").agg(F.max_by("n", "batch").alias("n"))
