"""Intermediate tables in the folder that the cluster shares, for results that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as Parquet below the session's `spark.checkpoint.dir` and read it back.

    Where that is unset on one machine (tests) a temporary folder is set; on a cluster that raises.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path below the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/marlstone/{tag}-{uuid.uuid4().hex}"
