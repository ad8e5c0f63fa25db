"""State of streams in levelled runs: few runs, crashes, repeated batches, late events, retired keys."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcurate.operators.events import correction_progress, job_status
from sparkcurate.streaming.jobs import CORRECTIONS, JOB_STATUS, replay_stream, stream_event_log
from sparkcurate.streaming.store import RunStore

EVENTS = "event_id long, job_id long, status string"


def events(n, seed=0):
    rng = random.Random(seed)
    kinds = ["pending", "running", "running", "running", "completed", "failed"]
    return [(i, rng.randrange(12), rng.choice(kinds)) for i in range(n)]


def plain(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_many_batches_leave_few_runs(spark, tmp_path):
    rows = events(120)
    random.Random(1).shuffle(rows)  # every batch holds early and late events
    store = RunStore(spark, str(tmp_path / "s"), JOB_STATUS, fan=3)
    for batch in range(40):
        store.add(spark.createDataFrame(rows[3 * batch : 3 * batch + 3], EVENTS).coalesce(1), batch)
        assert len(store.runs()) <= 2 * 4  # fewer than fan on each of the levels
    assert plain(store.current()) == plain(job_status(spark.createDataFrame(rows, EVENTS)))
    store.add(spark.createDataFrame(rows[:3], EVENTS), 17)  # a batch that is repeated
    assert plain(store.current()) == plain(job_status(spark.createDataFrame(rows, EVENTS)))


@pytest.mark.parametrize("written", [0, 1])
def test_a_crash_while_merging_loses_nothing(spark, tmp_path, monkeypatch, written):
    rows = events(60, 3)
    store = RunStore(spark, str(tmp_path / "s"), JOB_STATUS, fan=3)
    add = lambda b: store.add(spark.createDataFrame(rows[10 * b : 10 * b + 10], EVENTS).coalesce(1), b)
    add(0), add(1)
    real = store._write

    def crash(df, kind, first, last):
        if first != last:
            if written:  # the files are there, the commit marker is not
                real(df, kind, first, last)
                (tmp_path / "s" / f"{kind}-{first}-{last}" / "_SUCCESS").unlink()
            raise OSError("lost")
        real(df, kind, first, last)

    monkeypatch.setattr(store, "_write", crash)
    with pytest.raises(OSError):
        add(2)
    monkeypatch.setattr(store, "_write", real)
    want = plain(job_status(spark.createDataFrame(rows[:30], EVENTS)))
    assert len(store.runs()) == 3 and plain(store.current()) == want
    add(2)  # the engine repeats the batch
    assert store.runs() == [(0, 2)] and plain(store.current()) == want


def test_finished_keys_are_retired_and_late_events_still_count(spark, tmp_path, monkeypatch):
    rows = events(90, 5)
    store = RunStore(spark, str(tmp_path / "s"), JOB_STATUS, fan=4)
    df = spark.createDataFrame(rows, EVENTS).coalesce(1)
    late = (F.col("job_id") % 3 == 0) & (F.col("event_id") < 20)
    store.add(df.filter(~late & (F.col("event_id") < 60)), 0)
    store.add(df.filter(~late & (F.col("event_id") >= 60)), 1)
    real = store._write

    def crash(part, kind, first, last):
        if kind == "run":
            raise OSError("lost")
        real(part, kind, first, last)

    want = plain(job_status(df.filter(~late)))
    monkeypatch.setattr(store, "_write", crash)
    with pytest.raises(OSError):
        store.retire()
    monkeypatch.setattr(store, "_write", real)
    assert store.retired() == [] and plain(store.current()) == want
    store.retire()
    assert store.retired() == [(0, 1)] and store.runs() == [(0, 1)] and plain(store.current()) == want
    left = spark.read.parquet(str(tmp_path / "s" / "run-0-1"))
    assert left.filter("final is not null").count() == 0
    store.add(df.filter(late), 2)
    assert plain(store.current()) == plain(job_status(df))
    store.retire()
    assert plain(store.current()) == plain(job_status(df))
    assert RunStore(spark, str(tmp_path / "none"), JOB_STATUS).current() is None


def test_correction_runs(spark, tmp_path):
    rows = [(i % 4, ["started", "progress", "complete"][i % 3], 9) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id long, type string, total long").coalesce(1)
    store = RunStore(spark, str(tmp_path / "s"), CORRECTIONS)
    store.add(df.limit(13), 0)
    store.add(df.subtract(df.limit(0)).limit(0), 1)  # an empty batch
    store.add(df.exceptAll(df.limit(13)), 2)
    assert plain(store.current()) == plain(correction_progress(df))


def test_replay_from_a_place_goes_on_with_new_files(spark, tmp_path):
    folder, log, out = (str(tmp_path / n) for n in ("in", "log", "out"))
    seen = []
    for drop in range(3):
        part = [(100 * drop + i, i % 3, "running") for i in range(12)] + [(50 - drop, 1, "late")]
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENTS).parquet(folder)
        stream_event_log(stream, log, str(tmp_path / "mark"), buckets=4).awaitTermination()
        reader = replay_stream(spark, log, EVENTS, 1, 49, buckets=4)
        reader.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "place")).option(
            "path", out
        ).trigger(availableNow=True).start().awaitTermination()
        seen += [r for r in part if r[1] == 1 and r[0] >= 49]
        assert sorted(tuple(r) for r in spark.read.schema(EVENTS).parquet(out).collect()) == sorted(seen)
