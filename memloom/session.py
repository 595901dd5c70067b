"""A Spark session with the settings this library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.ignoreMissingFiles": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "memloom", **extra: str) -> SparkSession:
    """The running session, or a new one; ``extra`` names use ``__`` for dots."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
