"""What changes in a folder, as a stream: files that are added, changed or removed.

A Python data source. Its offset is the number of a written listing: each trigger lists the folder and, if anything
differs from the newest listing, writes the next one; a batch is the difference of two written listings, so a batch
that is run again gives the same rows, and a restart goes on from the listings. Listings no batch needs are removed.
Folder and listings lie on file systems that the driver mounts.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from memloom.functions import classify

SCHEMA = "path string, op string, size long, modified timestamp"
ROWS = 1000


class Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.listings = os.path.abspath(options["path"]), options["listings"]
        self.initial, self.settle = options.get("initial", "ignore"), float(options.get("settle", "0"))
        if self.initial not in ("ignore", "process"):
            raise ValueError("initial is ignore or process")
        os.makedirs(self.listings, exist_ok=True)

    def _load(self, n: int) -> dict[str, list[int]]:
        with open(f"{self.listings}/{n}.json", encoding="utf-8") as f:
            return json.load(f)

    def _write(self, n: int, listing: dict[str, list[int]]) -> None:
        """A listing appears whole or not at all."""
        path = f"{self.listings}/{n}.json"
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(listing, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.tmp", path)

    def _newest(self) -> int:
        return max((int(x[:-5]) for x in os.listdir(self.listings) if x.endswith(".json")), default=-1)

    def _now(self, before: dict[str, list[int]]) -> dict[str, list[int]]:
        """``path`` → size and time of change in nanoseconds; a file still being written keeps its place in ``before``."""
        out, newest = {}, time.time() - self.settle
        for top, _, names in os.walk(self.folder):
            for name in names:
                path = os.path.join(top, name)
                try:
                    s = os.stat(path)
                except FileNotFoundError:
                    continue
                if self.settle and s.st_mtime > newest:
                    if path in before:
                        out[path] = before[path]
                else:
                    out[path] = [s.st_size, s.st_mtime_ns]
        return out

    def _started(self) -> int:
        """The newest listing; the first start writes the one that says what counts as known."""
        if self._newest() < 0:
            self._write(0, self._now({}) if self.initial == "ignore" else {})
        return self._newest()

    def initialOffset(self) -> dict:
        self._started()
        return {"listing": 0}

    def latestOffset(self) -> dict:
        n = self._started()
        before = self._load(n)
        now = self._now(before)
        if now != before:
            n += 1
            self._write(n, now)
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        before, after = self._load(start["listing"]), self._load(end["listing"])
        rows = [(p, "add" if p not in before else "change", *after[p]) for p in after if before.get(p) != after[p]]
        rows += [(p, "delete", *before[p]) for p in before if p not in after]
        rows.sort()
        return [Changes(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        from datetime import UTC, datetime

        for path, op, size, ns in partition.rows:
            yield path, op, size, datetime.fromtimestamp(ns // 1000 / 1e6, UTC)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.listings):
            if name.endswith(".json") and int(name[:-5]) < end["listing"]:
                os.remove(f"{self.listings}/{name}")


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def changes(spark: SparkSession, folder: str, listings: str, ignore: list[str] = (), initial: str = "ignore", settle: float = 0) -> DataFrame:
    """A stream ``(path, op, size, modified)`` of what happens below ``folder``: add, change or delete.

    ``listings`` is a folder for the written listings, one for each stream, kept beside its checkpoint. ``initial``: whether
    files there at the first start are ignored or processed (each an add). ``settle``: seconds a file must have stayed as it
    is before it is listed. A file is changed if its size or its time of change is; several changes between two triggers are one.
    Paths that ``ignore`` or the fixed rules exclude are left out.
    """
    spark.dataSource.register(ListingSource)
    rows = spark.readStream.format("file_changes").option("path", folder).option("listings", listings).option("initial", initial).option("settle", str(settle)).load()
    return rows.filter(~classify.is_ignored(F.col("path"), list(ignore)))
