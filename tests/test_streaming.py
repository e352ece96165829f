"""Streams with late rows, restarts, replays and their progress, on small hand-made input."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators.store import clear_scratch, scratch
from folioscope.streaming import jobs
from folioscope.streaming.progress import ProgressLog
from folioscope.streaming.versions import Versions

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


FIRST = [(1, at(8, 5), 1, "view", 1.0), (2, at(8, 50), 1, "purchase", 2.0), (3, at(12, 0), 2, "view", 4.0), (4, at(12, 10), None, "view", None)]
#: 5 comes after its hour was closed, 6 comes late but in time, 8 moves the watermark past everything.
SECOND = [(5, at(8, 20), 1, "view", 100.0), (6, at(11, 40), 2, "view", 8.0), (7, at(13, 30), 2, "purchase", 16.0), (8, at(3, 0, 3), 9, "view", 0.0)]


def feed(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def events(spark, folder):
    return jobs.arrived(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def local(path):
    return path.removeprefix("file://")


def waves(spark, build, log=None, first=FIRST):
    folder, out, checkpoint = (scratch(spark, x) for x in ("in", "out", "checkpoint"))
    for rows in (first, SECOND):
        feed(spark, rows, folder)
        done = jobs.work_off(build(events(spark, folder)), checkpoint, out)
        if log:
            log.wait(done)
    return spark.read.parquet(out)


def test_windows_drop_late_rows(spark):
    got = waves(spark, lambda e: jobs.windowed_counts(e, late="1 hour"))
    hours = sorted((r["window_start"].day, r["window_start"].hour, r["event_type"], r["n"], r["value"]) for r in got.collect())
    # the watermark is 11:10 after the first wave: the row of 8:20 is gone, that of 11:40 counts; the last hour stays open
    assert hours == [(1, 8, "purchase", 1, 2.0), (1, 8, "view", 1, 1.0), (1, 11, "view", 1, 8.0), (1, 12, "view", 2, 4.0), (1, 13, "purchase", 1, 16.0)]


def test_sessions(spark):
    got = waves(spark, lambda e: jobs.sessions(e, gap="1 hour", late="1 hour"))
    found = sorted(((r["user_id"], r["session_start"].hour, r["session_start"].minute, r["n"], r["value"]) for r in got.collect()), key=repr)
    # a late row joins the session that is still open; a session of a null key is one of its own
    assert found == sorted([(1, 8, 5, 2, 3.0), (2, 11, 40, 2, 12.0), (None, 12, 10, 1, None), (2, 13, 30, 1, 16.0)], key=repr)
    # the same rows at once, nothing late, every session closed
    batch = jobs.sessions(spark.createDataFrame(FIRST + SECOND, SCHEMA), gap="1 hour")
    assert batch.count() == 5 and batch.where("user_id = 1").first()["n"] == 3
    assert jobs.sessions(spark.createDataFrame([], SCHEMA)).collect() == []


def test_followed(spark):
    def build(e):
        return jobs.followed(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", within="2 hours", late="1 hour")

    with ProgressLog(spark, scratch(spark, "progress")) as log:
        # the slower of the two streams sets the watermark: 11:05 after the first wave
        got = waves(spark, build, log, [*FIRST, (9, at(12, 5), 3, "purchase", 0.0)])
        told = log.table().where("kind = 'batch'").collect()
    assert sorted((r["event_id"], r["then_event_id"]) for r in got.collect()) == [(1, 2), (3, 7), (6, 7)]
    # the state was cleared of what can meet nothing any more, and late rows were counted
    assert sum(r["state_removed"] or 0 for r in told) > 0 and sum(r["state_late"] or 0 for r in told) == 1
    assert jobs.followed(spark.createDataFrame(FIRST, SCHEMA).where("event_type = 'view'"), spark.createDataFrame(FIRST, SCHEMA).where("event_type = 'purchase'"), "user_id").count() == 1


def test_restart_replays_a_batch(spark):
    """A batch that was written but not committed is run again and replaced, not added."""
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "checkpoint")
    counts = Versions(spark, scratch(spark, "table"), ["event_type"], spark.createDataFrame([], "event_type string, n long").schema)
    seen = []

    def each(batch, batch_id):
        seen.append(batch_id)
        counts.put(batch, batch_id)

    def run():
        jobs.work_off(events(spark, folder).groupBy("event_type").agg(F.count("*").alias("n")), checkpoint, each=each, mode="update")

    feed(spark, FIRST, folder)
    run()
    before = sorted(map(tuple, counts.current().collect()))
    assert before == [("purchase", 1), ("view", 3)]
    for f in glob.glob(local(checkpoint) + "/commits/*0") + glob.glob(local(checkpoint) + "/commits/.*0.crc"):
        os.remove(f)
    run()
    assert seen == [0, 0] and sorted(map(tuple, counts.current().collect())) == before
    feed(spark, SECOND, folder)
    run()
    assert seen == [0, 0, 1] and sorted(map(tuple, counts.current().collect())) == [("purchase", 2), ("view", 6)]


def test_inbox_takes_new_files_once(spark):
    folder, out, checkpoint = (scratch(spark, x) for x in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in (FIRST, SECOND, []):
        if rows:
            feed(spark, rows, folder)
        jobs.inbox(spark, folder, schema, out, checkpoint, lambda d: d.select("event_id"))
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(1, 9))


def test_progress(spark):
    with ProgressLog(spark, scratch(spark, "progress"), held=2) as log:
        waves(spark, lambda e: e.select("event_id"), log)
        told = log.table()
    assert [r[0] for r in told.where("kind = 'batch' and input_rows > 0").orderBy("batch").select("input_rows").collect()] == [4, 4]
    kinds = {r["kind"]: r["n"] for r in told.groupBy("kind").agg(F.countDistinct("run").alias("n")).collect()}
    assert kinds == {"started": 2, "batch": 2, "ended": 2}


def test_progress_of_a_failure(spark):
    folder, checkpoint = scratch(spark, "in"), scratch(spark, "checkpoint")
    feed(spark, FIRST, folder)

    def each(batch, batch_id):
        raise RuntimeError("this batch can't be written")

    with ProgressLog(spark, scratch(spark, "progress")) as log:
        with pytest.raises(Exception, match="can't be written"):
            jobs.work_off(events(spark, folder), checkpoint, each=each, name="failing")
        (started,) = [r for r in log._rows if r[0] == "started"]
        log.wait(type("Query", (), {"runId": started[2]}))
        (ended,) = log.table().where("kind = 'ended'").collect()
    assert "can't be written" in ended["error"]


def test_versions(spark):
    schema = spark.createDataFrame([], "k long, v string, extra long").schema
    table = Versions(spark, scratch(spark, "versions"), ["k"], schema, F.struct("extra", "v"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "n", 0), (2, None, None)], schema)
    assert rows(table.current()) == []
    table.put(one, 3)
    table.put(one, 3)
    wanted = [(1, "b", 2), (2, None, None), (None, "n", 0)]
    assert rows(table.current()) == wanted
    table.put(spark.createDataFrame([], schema), 4)
    table.put(spark.createDataFrame([(2, "c", 5)], schema), 5)
    wanted[1] = (2, "c", 5)
    assert rows(table.current()) == wanted
    table.compact()
    assert rows(table.current()) == wanted and table._numbers("log", "batch_id") == []
    # batches that the base holds are known; later ones count; a second folding keeps all
    table.put(one, 3)
    assert rows(table.current()) == wanted
    table.put(spark.createDataFrame([(7, "d", 1)], schema), 6)
    table.compact()
    table.compact()
    assert rows(table.current()) == sorted([*wanted, (7, "d", 1)], key=repr)


def test_versions_survive_a_broken_compaction(spark, monkeypatch):
    """Between the new base and the deletion of what it replaces, everything is there once."""
    schema = spark.createDataFrame([], "k long, v string").schema
    table = Versions(spark, scratch(spark, "versions"), ["k"], schema)
    for n in range(2):
        table.put(spark.createDataFrame([(n, "x"), (9, str(n))], schema), n)
    monkeypatch.setattr("folioscope.streaming.versions.discard", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.compact()
    monkeypatch.undo()
    assert sorted(map(tuple, table.current().collect())) == [(0, "x"), (1, "x"), (9, "1")]
    table.compact()
    assert sorted(map(tuple, table.current().collect())) == [(0, "x"), (1, "x"), (9, "1")] and table._numbers("log", "batch_id") == []


def test_scratch_is_cleared(spark):
    path = scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    assert not os.path.exists(local(path))
