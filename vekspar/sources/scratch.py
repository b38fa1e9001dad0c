"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where it is unset and the master is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark, "_vekspar_scratch", None) or tempfile.mkdtemp(prefix="vekspar-")
        spark._vekspar_scratch = root
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: it is computed once, and a lost executor costs nothing."""
    path = f"{folder(df.sparkSession)}/vekspar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
