"""Tables written between the steps of one operator, in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a local session; on a cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memloom-scratch-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Writes a DataFrame as Parquet and reads it back: lineage is cut, and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _OPEN:
            _OPEN[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(df.scratch_path)

    def clear(self) -> None:
        """Delete every table of this scratch."""
        self._delete(self.root)


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """Deletes the scratch tables made inside at the end: for steps whose result was written elsewhere meanwhile."""
    _OPEN.append([])
    try:
        yield
    finally:
        for scratch in _OPEN.pop():
            scratch.clear()
