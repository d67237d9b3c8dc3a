"""Tables that a result needs twice: written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoScratchError(RuntimeError):
    """A cluster whose configuration names no folder that all executors share."""


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a local master gets a folder of its own, while a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoScratchError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str = "kept") -> DataFrame:
    """df written once and read back; what needs it twice doesn't work it out twice."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
