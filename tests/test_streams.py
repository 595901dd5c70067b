"""State that ends, and the listing source: streams against tables, restarts, replays."""

import os

import pytest
from pyspark.sql import functions as F

from memloom.sources import listing
from memloom.streaming import events, state

START = 1_700_000_000


@pytest.fixture(autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def rows_of(spark, rows, schema):
    return spark.createDataFrame([(p, op, s, *rest) for p, op, s, *rest in rows], schema).withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("s"))).drop("s")


def run(df, folder, got, fail=None):
    def take(batch, n):
        rows = list(map(tuple, batch.collect()))
        if fail and fail.pop("once", False) and rows:
            raise RuntimeError("lost")
        got.extend(rows)

    query = df.writeStream.foreachBatch(take).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query


def test_flights_end(spark, tmp_path):
    parts = [[("a", "add", 0), ("a", "change", 1), ("b", "add", 2), (None, "add", 2)], [("a", "change", 2), ("a", "delete", 3), ("b", "change", 4)], [("a", "add", 5), ("a", "change", 6), ("b", "delete", 5)], [("end", "add", 100_000)], [("end", "change", 200_000)]]
    every = None
    for i, part in enumerate(parts):
        df = rows_of(spark, part, "path string, op string, s int")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        os.utime(next((tmp_path / f"in/{i}").glob("part-*")), (START + i, START + i))
        every = df if every is None else every.unionByName(df)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []
    run(state.flights(stream), f"{tmp_path}/cp", got)
    assert sorted(got) == sorted(map(tuple, events.in_flight_once(every).collect()))
    left = spark.read.format("statestore").option("stateVarName", "until").load(f"{tmp_path}/cp")
    assert {r[0] for r in left.select("key.path").collect()} <= {"end"}  # a and b have ended


def test_actions_like_a_table(spark, tmp_path):
    schema = "path string, op string, s int, memory_ids array<string>"
    first = [("a", "change", 1, ["2"]), ("a", "change", 2, ["2", "4"]), ("b", "delete", 1, ["3"]), ("c", "add", 1, ["5", "5", None]), ("d", "add", 1, None)]
    second = [("a", "delete", 9, None), ("c", "change", 9, ["6"])]
    for i, part in enumerate((first, second)):
        rows_of(spark, part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        os.utime(next((tmp_path / f"in/{i}").glob("part-*")), (START + i, START + i))
    tracker = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("z", "9")], "path string, memory_id string")
    stream = spark.readStream.schema("path string, op string, memory_ids array<string>, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got, fail = [], {"once": True}
    with pytest.raises(Exception, match="lost"):
        run(state.actions(stream, tracker), f"{tmp_path}/cp", got, fail)
    assert got == []
    run(state.actions(stream, tracker), f"{tmp_path}/cp", got)  # the lost batch again, then the next one
    want = []
    now = tracker
    for part in (first, second):
        e = rows_of(spark, part, schema)
        last = e.groupBy("path").agg(F.max_by("memory_ids", F.struct("ts", "op")).alias("m"))
        current = last.select("path", F.explode("m").alias("memory_id")).filter("memory_id is not null")
        done = events.plan(e, now, current)
        want += list(map(tuple, done.collect()))
        left = done.filter("action <> 'forget'").select("path", "memory_id")
        now = spark.createDataFrame(now.join(e, "path", "left_anti").select("path", "memory_id").union(left).collect(), "path string, memory_id string")
    assert sorted(got) == sorted(want)
    held = spark.read.format("statestore").option("stateVarName", "members").load(f"{tmp_path}/cp")
    assert {r[0] for r in held.select("key.path").distinct().collect()} == {"c", "z"}


def test_listing_of_adds_changes_and_deletes(spark, tmp_path):
    src, lists = tmp_path / "in", f"{tmp_path}/lists"
    (src / "sub").mkdir(parents=True)
    (src / "old.md").write_text("1")
    (src / "sub/gone.md").write_text("2")
    (src / ".env").write_text("secret")
    got = []
    stream = lambda **kw: listing.changes(spark, str(src), lists, **kw).select(F.substring_index("path", "/", -1), "op")
    run(stream(), f"{tmp_path}/cp", got)
    assert got == []  # what is there is ignored
    (src / "new.md").write_text("3")
    (src / "old.md").write_text("changed")
    (src / "sub/gone.md").unlink()
    fail = {"once": True}
    with pytest.raises(Exception, match="lost"):
        run(stream(), f"{tmp_path}/cp", got, fail)
    (src / "later.md").write_text("4")
    run(stream(), f"{tmp_path}/cp", got)  # restarted from the checkpoint: the lost batch again
    assert {"gone.md", "new.md", "old.md"} <= {p for p, _ in got}
    run(stream(), f"{tmp_path}/cp", got)  # and what came meanwhile, if it was not there yet
    assert sorted(got) == [("gone.md", "delete"), ("later.md", "add"), ("new.md", "add"), ("old.md", "change")]
    run(stream(), f"{tmp_path}/cp", got)
    assert len(got) == 4 and len([x for x in os.listdir(lists) if x.endswith(".json")]) <= 2


def test_listing_of_what_is_there(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("1")
    got = []
    run(listing.changes(spark, f"{tmp_path}/in", f"{tmp_path}/lists", initial="process").select("op", "size"), f"{tmp_path}/cp", got)
    assert got == [("add", 1)]
    with pytest.raises(Exception, match="initial is"):
        run(listing.changes(spark, f"{tmp_path}/in", f"{tmp_path}/l2", initial="some"), f"{tmp_path}/cp2", got)


def test_files_still_being_written_wait(tmp_path):
    (tmp_path / "in").mkdir()
    reader = listing.ListingReader({"path": f"{tmp_path}/in", "listings": f"{tmp_path}/l", "settle": "3600"})
    reader.initialOffset()
    (tmp_path / "in/a.md").write_text("1")
    assert reader.latestOffset() == {"listing": 0}
    os.utime(tmp_path / "in/a.md", (START, START))
    assert reader.latestOffset() == {"listing": 1} and [r[1] for c in reader.partitions({"listing": 0}, {"listing": 1}) for r in c.rows] == ["add"]
