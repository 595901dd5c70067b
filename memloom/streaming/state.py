"""Keyed state of file events that ends: flights with timers, and the memories of each path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT, ACTION = "path string, op string, ts timestamp", "path string, memory_id string, action string"


def keyed_state(spark: SparkSession) -> None:
    """Timers and maps need the RocksDB state store; other streams of the session that start afterwards use it too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def plain(values) -> pd.Series:
    """Strings as objects: Arrow takes no strings in pieces here."""
    return pd.Series(list(values), dtype=object)


class Flights(StatefulProcessor):
    """An event opens a flight of ``span``; further events of its path are dropped until it ends. A timer then drops the path's state."""

    def __init__(self, span: str):
        self.span = pd.Timedelta(span)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "op"])
        table = table[table["ts"].notna()]
        until, kept = self.until.get()[0] if self.until.exists() else None, []
        for t in table["ts"]:
            now = t.value // 1000
            kept.append(until is None or now >= until)
            if kept[-1]:
                until = now + self.span.value // 1000
        if any(kept):
            self.until.update((until,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(-(-until // 1000))
        table = table[kept]
        yield pd.DataFrame({"path": plain(table["path"]), "op": plain(table["op"]), "ts": table["ts"].array})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def flights(events: DataFrame, span: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """``events.in_flight_once`` for a stream ``(path, op, ts)`` whose state ends: a path's row goes when the watermark passes its flight's end.

    Events later than ``late`` behind the newest are dropped, as are those without a path or a time.
    """
    keyed_state(events.sparkSession)
    known = events.select("path", "op", "ts").filter("path is not null and ts is not null").withWatermark("ts", late)
    return known.groupBy("path").transformWithStateInPandas(Flights(span), EVENT, "Append", "EventTime")


class Members(StatefulProcessor):
    """The memory ids of each path. A path's last event of a batch says what it holds now: new ids are remembered, stale ones forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "memory_id string", "held boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for m in initialState["memory_id"]:
            self.members.updateValue((m,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for table in rows:
            for op, ts, ids in zip(table["op"], table["ts"], table["memory_ids"], strict=True):
                if last is None or (ts, op) >= last[:2]:
                    last = (ts, op, ids)
        now = set() if last[1] == "delete" or last[2] is None else {m for m in last[2] if m is not None}
        old = {k[0] for k in self.members.keys()} if self.members.exists() else set()
        for m in old - now:
            self.members.removeKey((m,))
        for m in now - old:
            self.members.updateValue((m,), (True,))
        out = [(m, "remember" if m not in old else "keep" if m in now else "forget") for m in sorted(old | now)]
        yield pd.DataFrame({"path": plain([key[0]] * len(out)), "memory_id": plain([m for m, _ in out]), "action": plain([a for _, a in out])})

    def close(self) -> None:
        pass


def actions(events: DataFrame, tracker: DataFrame | None = None) -> DataFrame:
    """``(path, memory_id, action)`` of a stream ``(path, op, ts, memory_ids)``: remember, keep or forget, as ``events.plan`` gives it for tables.

    ``memory_ids`` is what the path's file holds at the event. ``tracker(path, memory_id)`` is what paths had before the
    first batch. Each path's ids are a map in the state, one entry an id; a deleted path leaves nothing behind. Of
    events of one moment the largest name counts; null paths are left out. A batch that is run again gives the same rows.
    """
    keyed_state(events.sparkSession)
    known = events.select("path", "op", "ts", "memory_ids").filter("path is not null and op is not null and ts is not null")
    first = None if tracker is None else tracker.select("path", "memory_id").filter("path is not null and memory_id is not null").groupBy("path")
    return known.groupBy("path").transformWithStateInPandas(Members(), ACTION, "Append", "None", initialState=first)
