"""Bounded Arrow batches for the columns that Python computes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch; texts may be very long, and two workers share an executor's memory.
ROWS, BYTES = 500, 8 << 20


def bounded() -> None:
    """Lower the active session's Arrow batch limits to ROWS and BYTES; lower limits stay.

    Spark reads the limits when a query runs, after the operator has returned, so they stay set. They
    bound memory alone: no result of this library depends on how rows fall into batches.
    """
    spark = SparkSession.active()
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS:
        spark.conf.set(rows, str(ROWS))
    if spark.sparkContext.getConf().get(size) is None:
        spark.conf.set(size, str(BYTES))
