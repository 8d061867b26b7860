"""The latest-state table of a stream: each batch counts once, whenever it was killed."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from foliospark.operators import jobs
from foliospark.streaming.latest import LatestTable
from tests.test_jobevents import EVENTS, some_events


def table(spark, path):
    return LatestTable(spark, path, ["run"], lambda rows: jobs.progress_state(rows, ["run"], "place"), lambda states: jobs.merged_state(states, ["run"]), buckets=4)


def shown(spark, t, frame):
    schema = jobs.progress_state(frame, ["run"], "place").schema
    return sorted(map(str, jobs.shown_state(t.current(schema), ["run"]).collect()))


def wanted(frame):
    return sorted(map(str, jobs.progress(frame, ["run"], "place").collect()))


def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    rows = [r for r in some_events(200, 6) if r[0]]
    path, checkpoint = str(tmp_path / "latest"), str(tmp_path / "checkpoint")
    for n in range(4):
        spark.createDataFrame(rows[n * len(rows) // 4 : (n + 1) * len(rows) // 4], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))

    def run(t):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
        t.follow(stream, checkpoint).awaitTermination()

    killed = table(spark, path)
    whole = killed._commit
    monkeypatch.setattr(killed, "_commit", lambda number, touched: whole(number, touched) if number != 2 else (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(StreamingQueryException, match="killed"):
        run(killed)
    again = table(spark, path)
    assert again.committed() == 1 and max(v for b in range(4) for v in again.versions(b)) == 2
    # What was written without being committed isn't seen.
    before = spark.createDataFrame(rows[: 2 * len(rows) // 4], EVENTS)
    assert shown(spark, again, before) == wanted(before)
    run(again)
    frame = spark.createDataFrame(rows, EVENTS)
    assert again.committed() == 3 and shown(spark, again, frame) == wanted(frame)
    assert all(len(again.versions(b)) <= 2 for b in range(4))


def test_batches_in_any_division_and_twice(spark, tmp_path):
    rows = some_events(120, 8)
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, EVENTS)
    t = table(spark, str(tmp_path / "t"))
    assert shown(spark, t, frame) == [] and t.committed() == -1
    for n in range(3):
        part = spark.createDataFrame(rows[n::3], EVENTS)
        t.write(part, n)
        t.write(part, n)
    t.write(frame.where("false"), 3)
    assert shown(spark, t, frame) == wanted(frame) and t.committed() == 3
