"""Streams of file events: debouncing, one event in flight for a path, applying to a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.streaming import state

GAP, LATE = "3 seconds", "10 minutes"


def settled(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """``(path, op, ts, n)``: of ``events(path, op, ts)`` the last of each run without a pause of ``gap``.

    Works on tables and streams; on a stream a run is given out once the watermark has passed it.
    Of events at one moment the largest name counts.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    runs = rows.groupBy("path", F.session_window("ts", gap)).agg(F.max_by("op", F.struct("ts", "op")).alias("op"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return runs.select("path", "op", F.col("last").alias("ts"), "n")


def opened(path: pd.Series, ts: pd.Series, until: dict, span: pd.Timedelta) -> list[bool]:
    """Which events open a flight: those at or after the end of their path's last one, which ``until`` holds."""
    out = []
    for p, t in zip(path, ts, strict=True):
        free = p not in until or t >= until[p]
        if free:
            until[p] = t + span
        out.append(free)
    return out


def in_flight_once(events: DataFrame, span: str = "3 seconds") -> DataFrame:
    """``(path, op, ts)``: an event opens a flight of ``span``; the path's further events are dropped until it ends, then the next one opens.

    On tables events are taken in order of time, of equal moments the smallest name first; on streams in the order in which
    they arrive, by batches in order of time. So both agree where events arrive in order. Events without a path or a time are
    left out. Tables go through a sort within partitions by path, and hold one path's flight at a time; streams keep a path's
    flight until it ends (``state.flights``).
    """
    if events.isStreaming:
        return state.flights(events, span)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        until: dict = {}
        for table in batches:
            keep = opened(table["path"], table["ts"], until, pd.Timedelta(span))
            last = table["path"].iloc[-1] if len(table) else None
            until = {last: until[last]} if last in until else {}
            yield table[keep]

    known = events.select("path", "op", "ts").filter("path is not null and ts is not null")
    return known.repartition("path").sortWithinPartitions("path", "ts", "op").mapInPandas(first, "path string, op string, ts timestamp")


def plan(events: DataFrame, tracker: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, memory_id, action)``: what settled ``events(path, op)`` do to the memories of each path.

    ``tracker(path, memory_id)`` is what a path had, ``current(path, memory_id)`` what its file holds
    now. Added and changed files remember what is new, keep what stays and forget what is stale; a
    deleted file forgets all.
    """
    last = events.groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))
    old = tracker.join(last, "path").select("path", "memory_id", F.lit(True).alias("__o"))
    live = current.join(last.filter("op <> 'delete'"), "path", "left_semi").select("path", "memory_id").distinct().withColumn("__n", F.lit(True))
    both = old.distinct().join(live, ["path", "memory_id"], "full_outer")
    action = F.when(F.col("__o").isNull(), "remember").when(F.col("__n").isNull(), "forget").otherwise("keep")
    return both.select("path", "memory_id", action.alias("action"))


def run(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start a stream that hands each batch of settled events to ``apply``; ``once`` takes what there is and stops."""
    writer = settled(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
