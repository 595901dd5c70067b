"""Tables written between the steps of one answer, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder for a local session, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and safe from lost executors."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def few(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` computed once: rows held by the plan itself if they are at most ``limit``, so that joins with them are broadcast; more are a written table."""
    rows = df.limit(limit + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= limit else written(df, new_folder(df.sparkSession, "rows"))
