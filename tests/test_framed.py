"""Framed logs: frames, offsets, and what failed and repeated batches leave behind."""

import datetime as dt
import os

import pyarrow as pa
import pytest

from gridpulse.catalog import streams
from gridpulse.session import scratch
from gridpulse.sources import framed
from gridpulse.streaming import jobs, runner


def batch(*messages):
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in messages], pa.string()), pa.array([m[1] for m in messages], pa.binary())], names=["subject", "payload"])


def drained(stream, spark, checkpoint):
    out = scratch(spark, "out")
    runner.drain(stream, jobs.store_updates(out), checkpoint)
    return sorted(tuple(r) for r in spark.read.parquet(out).select("subject", "payload").collect())


def test_frames_round_trip():
    messages = [("a.b", b"\x00\xff"), ("", b""), (None, b"x"), ("ü", None)]
    data = b"".join(framed.frame(*m) for m in messages)
    assert [tuple(r.values()) for r in framed.unframe(data).to_pylist()] == messages
    assert framed._whole(data[:-1]) == len(data) - len(framed.frame(*messages[-1]))
    with pytest.raises(Exception):
        framed.unframe(data[:-1])


def test_commit_is_finished_and_not_repeated(spark, monkeypatch):
    path = scratch(spark, "logs")
    writer = framed._Writer(path, 2)
    first = [writer.write(iter([batch(("a", b"1"))])), writer.write(iter([batch(("b", b"2"))])), None]
    store, _ = framed._open(path)
    monkeypatch.setattr(framed, "_open", lambda p: (Breaking(store), p))
    with pytest.raises(OSError):
        writer.commit(first, 0)
    monkeypatch.undo()
    again = [writer.write(iter([batch(("a", b"1"))])), writer.write(iter([batch(("b", b"2"))]))]
    writer.commit(again, 0)
    writer.commit([writer.write(iter([batch(("a", b"1"))]))], 0)
    writer.abort([writer.write(iter([batch(("c", b"3"))]))], 1)
    assert os.listdir(f"{path}/_pending") == []
    got = sorted((r["subject"], r["payload"]) for p in framed.stretches(path, {}, framed.ends(path)) for b in framed.read_stretch(path, p) for r in b.to_pylist())
    assert got == [("a", b"1"), ("b", b"2")]


class Breaking:
    """A file system that moves the note of a commit and then breaks."""

    def __init__(self, store):
        self.store = store

    def __getattr__(self, name):
        return getattr(self.store, name)

    def move(self, source, target):
        if target.endswith(".seg"):
            raise OSError("lost")
        self.store.move(source, target)


def test_failing_task_leaves_nothing(spark):
    path = scratch(spark, "logs")

    def breaking():
        yield batch(("a", b"1"))
        raise ValueError("lost")

    with pytest.raises(ValueError):
        framed._Writer(path, 2).write(breaking())
    assert os.listdir(f"{path}/_pending") == [] and framed.ends(path) == {}


def test_long_messages_and_segments(spark, monkeypatch):
    monkeypatch.setattr(framed, "SEGMENT_BYTES", 40)
    monkeypatch.setattr(framed, "BATCH_BYTES", 16)
    path = scratch(spark, "logs")
    writer = framed._Writer(path, 1)
    messages = [(f"s{i}", bytes([i]) * (7 * i)) for i in range(12)]
    writer.commit([writer.write(iter([batch(*messages)]))], 0)
    assert len(framed.segments(path)["0"]) > 3
    parts = framed.stretches(path, {}, framed.ends(path))
    assert [(r["subject"], r["payload"]) for p in parts for b in framed.read_stretch(path, p) for r in b.to_pylist()] == messages
    os.remove(parts[1].file)
    with pytest.raises(RuntimeError):
        framed.stretches(path, {}, {"0": parts[-1].high + 1000})


def test_stream_goes_on_at_its_offset(spark):
    path, checkpoint = scratch(spark, "logs"), scratch(spark, "progress")
    writer = framed._Writer(path, 2)
    writer.commit([writer.write(iter([batch(("a", b"1"), ("b", None))]))], 0)
    before = framed.ends(path)
    assert drained(framed.framed_stream(spark, path), spark, checkpoint) == [("a", b"1"), ("b", None)]
    writer.commit([writer.write(iter([batch(("c", b"3"))])), writer.write(iter([batch(("d", b"4"))]))], 1)
    assert drained(framed.framed_stream(spark, path), spark, checkpoint) == [("c", b"3"), ("d", b"4")]
    late = drained(framed.framed_stream(spark, path, before), spark, scratch(spark, "progress"))
    assert late == [("c", b"3"), ("d", b"4")]
    assert framed.framed_table(spark, path).count() == 4 and framed.framed_table(spark, path + "-none").count() == 0


def test_failed_batch_is_published_once(spark):
    source, path, checkpoint, flag = (scratch(spark, name) for name in ("rows", "logs", "progress", "flag"))
    spark.range(20, numPartitions=4).selectExpr("cast(id as string) as subject", "cast(cast(id as string) as binary) as payload").write.parquet(source)

    def fail_once(batches):
        for one in batches:
            yield one
            if not os.path.exists(flag) and "7" in one["subject"].to_pylist():
                raise ValueError("lost")

    stream = spark.readStream.schema(framed.SCHEMA).parquet(source).mapInArrow(fail_once, framed.SCHEMA)
    with pytest.raises(Exception):
        framed.publish_framed(stream, path, checkpoint).awaitTermination()
    assert framed.ends(path) == {}
    open(flag, "w").close()
    for _ in range(2):
        framed.publish_framed(stream, path, checkpoint).awaitTermination()
    assert sorted(int(r.subject) for r in framed.framed_table(spark, path).collect()) == list(range(20))


def test_repeated_batch_of_a_handler_adds_nothing(spark):
    path = scratch(spark, "logs")
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2")], framed.SCHEMA)
    for number in (0, 0, 1):
        framed.publish_framed_batch(rows, path, number)
    got = sorted(r.subject for r in framed.framed_table(spark, path).collect())
    assert got == ["a", "a", "b", "b"] and os.listdir(f"{path}/_pending") == []


def test_the_maxima_of_a_batch_are_made_once_for_both_tries(spark, tmp_path, monkeypatch):
    """The second try of a batch reads what the first had, instead of running the state again."""
    rows = [(i, dt.datetime(2024, 1, 1), i % 5, "click", float(i), "") for i in range(50)]
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    kept, publish = [], framed.publish_framed_batch
    monkeypatch.setattr(framed, "publish_framed_batch", lambda sent, *a: (kept.append(sent.is_cached), publish(sent, *a)))
    got = streams.stream_published(spark, str(tmp_path))
    assert sorted(float(m) for _, m in got.collect()) == [45.0, 46.0, 47.0, 48.0, 49.0]
    assert kept and all(kept)
