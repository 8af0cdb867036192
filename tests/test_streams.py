"""Streams over several micro-batches, with a restart after each; the answers are worked out by hand."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import usage
from lodestone.streaming import streams

T0 = datetime(2026, 3, 1)


def hours(h):
    return T0 + timedelta(hours=h)


class Feed:
    """A job that is given one batch of rows after another."""

    def __init__(self, spark, tmp_path, schema, job, mode="append", write=None):
        self.spark, self.schema, self.job, self.mode, self.write = spark, schema, job, mode, write
        self.folder, self.checkpoint, self.out = (f"{tmp_path}/{uuid.uuid4().hex}" for _ in range(3))
        self.n = 0

    def give(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).write.parquet(f"{self.folder}/{self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/*")
        streams.drain(self.job(stream), self.mode, self.write, self.out, self.checkpoint)
        return self

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(self.out).drop("batch").collect()), key=str)


def test_silence_is_told_once_and_ends_with_news(spark, tmp_path):
    feed = Feed(spark, tmp_path, "who string, at timestamp", lambda s: streams.silence_alerts(s, ["who"], "at"))
    feed.give(("a", hours(0)), ("b", hours(0)), ("b", hours(1)), ("a", None))
    assert feed.rows() == []
    feed.give(("b", hours(37)))  # 37 is past 36 hours after a; b spoke at 1 and 37: exactly the limit, no silence
    assert feed.rows() == [("a", hours(0))]
    feed.give(("b", hours(40)))
    assert feed.rows() == [("a", hours(0))]  # once per silence
    feed.give(("a", hours(50)), ("b", hours(60)))
    assert feed.rows() == [("a", hours(0))]  # news: told already, and a new silence begins
    feed.give(("c", hours(87)))
    assert feed.rows() == [("a", hours(0)), ("a", hours(50))]
    feed.give(("b", hours(200)), ("b", hours(201)))  # b was silent from 60 on, seen by its own news; c from 87 on, by the timer
    assert feed.rows() == [("a", hours(0)), ("a", hours(50)), ("b", hours(60)), ("c", hours(87))]


LEDGER = "kind string, seq long, reservation_seq long, run string, job string, day string, up long, down long"


def test_ledger_months_over_five_batches(spark, tmp_path):
    record = lambda kind, seq, of, run, day, up, down, job="j": (kind, seq, of, run, job, day, up, down)
    batches = [
        [record("reservation", 1, None, "r1", "2026-01-05", 100, 10), record("settlement", 90, 2, "r2", None, 70, 99), record("pre_ledger_usage", 3, None, None, "2026-01-01", 5, None)],
        [record("reservation", 2, None, "r2", "2026-01-31", 80, 8), record("settlement", 91, 1, "other", None, 1, 1)],
        [record("settlement", 92, 1, "r1", None, 30, 3), record("reservation", 4, None, "r4", "2026-02-01", 40, 4)],
        [record("settlement", 93, 1, "r1", None, 60, 1), record("reservation", 5, None, "r5", "2026-02-02", 7, 7, "k")],
        [record("settlement", 94, 5, "r5", None, None, 2), record("reservation", 6, None, None, "2026-02-03", 11, 1)],
    ]
    out, by, dims = f"{tmp_path}/sums", ["job", "day"], ["up", "down"]
    feed = Feed(spark, tmp_path, LEDGER, lambda s: streams.ledger_changes(s, by, dims), write=streams.summed(by, out))
    months = {"job": F.col("job"), "month": F.substring("day", 1, 7)}
    total = lambda: sorted(tuple(r) for r in streams.rolled_up([spark.read.parquet(out).drop("batch")], months).collect())
    told = []
    for rows in batches:
        feed.give(*rows)
        told.append(total())
    assert told[0] == [("j", "2026-01", 105, 10, 2, 1)]
    assert told[1] == [("j", "2026-01", 175, 18, 3, 1)]  # settled before it was reserved: min(80, 70), min(8, 99)
    assert told[2] == [("j", "2026-01", 105, 11, 3, 0), ("j", "2026-02", 40, 4, 1, 1)]
    assert told[3] == [("j", "2026-01", 135, 11, 3, 0), ("j", "2026-02", 40, 4, 1, 1), ("k", "2026-02", 7, 7, 1, 1)]  # the greatest settlement counts
    assert told[4] == [("j", "2026-01", 135, 11, 3, 0), ("j", "2026-02", 51, 5, 2, 2), ("k", "2026-02", 0, 2, 1, 0)]
    whole = spark.createDataFrame([r for rows in batches for r in rows], LEDGER).withColumn("month", F.substring("day", 1, 7))
    assert sorted(tuple(r) for r in usage.usage(whole, ["job", "month"], dims).collect()) == told[4]


def test_admissions_count_until_their_run_settles(spark, tmp_path):
    out, by = f"{tmp_path}/sums", ["job", "day"]
    feed = Feed(spark, tmp_path, "kind string, run string, job string, day string", lambda s: streams.admission_changes(s, by, ["up"], {"up": 50}), write=streams.summed(by, out))
    total = lambda: sorted(tuple(r) for r in streams.rolled_up([spark.read.parquet(out).drop("batch")], {"month": F.substring("day", 1, 7)}).collect())
    feed.give(("admission", "r1", "j", "2026-01-02"), ("admission", "r2", "j", "2026-01-03"), ("admission", None, "j", "2026-01-03"))
    assert total() == [("2026-01", 100, 0, 0)]
    feed.give(("settlement", "r1", None, None), ("settlement", "r3", None, None), ("admission", "r4", "j", "2026-02-01"))
    assert total() == [("2026-01", 50, 0, 0), ("2026-02", 50, 0, 0)]
    feed.give(("settlement", "r1", None, None), ("admission", "r3", "j", "2026-02-01"), ("settlement", "r4", None, None))
    assert total() == [("2026-01", 50, 0, 0)]


def test_writes_after_a_deletion_began_are_refused_and_counted(spark, tmp_path):
    schema = "kind string, id long, person string, at timestamp, note string"
    job = lambda s: streams.late_writes(s.where("kind = 'write'").drop("kind"), s.where("kind = 'delete'").select("person", "at"), "person", "at")
    out = f"{tmp_path}/apart"
    feed = Feed(spark, tmp_path, schema, job, write=streams.apart(out))
    write = lambda i, who, h, note=None: ("write", i, who, hours(h), note)
    feed.give(write(1, "p", 1), ("delete", None, "p", hours(2), None), write(2, "p", 2), write(3, "p", 3), write(4, "q", 3, "é"), write(5, None, 9))
    feed.give(write(6, "p", 0), write(7, "q", 4))  # older than the deletion, but it comes after
    feed.give(("delete", None, "q", hours(5), None), write(8, "p", 6), write(9, "q", 4), write(10, "q", 6, "x"))
    took = {tuple(r) for r in spark.read.parquet(f"{out}/accepted").drop("batch").collect()}
    assert took == {(1, "p", hours(1), None), (4, "q", hours(3), "é"), (5, None, hours(9), None), (7, "q", hours(4), None), (9, "q", hours(4), None)}
    refused = {(r.id, r.person, r.late_no) for r in spark.read.parquet(f"{out}/refused").collect()}
    assert refused == {(2, "p", 1), (3, "p", 2), (6, "p", 3), (8, "p", 4), (10, "q", 1)}


@pytest.fixture
def stored(spark, tmp_path):
    path = f"{tmp_path}/stored"
    spark.createDataFrame([(1, "a")], "id long, digest string").write.parquet(f"{path}/batch=-1")
    return path


def test_guarded_append(spark, stored):
    put = streams.guarded_append(stored, "id", "digest")
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, digest string")
    have = lambda: sorted((r.id, r.digest) for r in spark.read.parquet(stored).collect())
    put(frame((1, "a"), (2, "b"), (2, "b")), 0)
    assert have() == [(1, "a"), (2, "b")]
    put(frame((1, "a"), (2, "b"), (2, "b")), 0)  # the batch runs again
    assert have() == [(1, "a"), (2, "b")]
    for bad in ([(2, "c")], [(3, "x"), (3, "y")], [(3, None)], [(None, "x")], [(1, None)]):
        with pytest.raises(ValueError):
            put(frame(*bad, (9, "z")), 1)
        assert have() == [(1, "a"), (2, "b")]
    put(frame((3, "x")), 1)
    assert have() == [(1, "a"), (2, "b"), (3, "x")]


def test_state_goes_on_over_batches(spark, tmp_path):
    obs = "id long, who string, at long, status int, digest string, retained boolean, failed boolean"
    feed = Feed(spark, tmp_path, obs, lambda s: streams.changes(s, ["who"], ["at"], "id"))
    feed.give((1, "a", 1, 200, "x", True, False), (2, "a", 2, 0, None, True, True))
    feed.give((3, "a", 3, 200, "x", True, False), (4, "a", 4, 304, None, True, False)).give((5, "a", 5, 200, "y", False, False), (6, "a", 6, 304, None, True, False))
    assert feed.rows() == [(1, "new"), (2, "invalid"), (3, "unchanged_same_hash"), (4, "unchanged"), (5, "changed"), (6, "invalid")]
    feed = Feed(spark, tmp_path, obs, lambda s: streams.failure_alerts(s, ["who"], ["at"], "id"))
    for i in range(1, 9):
        feed.give((i, "a", i, 0, None, True, i != 4))
    assert feed.rows() == [(3,), (7,)]


def test_a_stream_without_rows(spark):
    none = spark.createDataFrame([], "who string, at timestamp")
    out = streams.replay(none, F.unix_micros("at"), lambda s: streams.silence_alerts(s, ["who"], "at"), "append")
    assert spark.read.parquet(out).drop("batch").collect() == []
