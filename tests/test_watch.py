"""Timeouts and retries of a watched stream, against a sequential replay."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliospark.operators import passes
from foliospark.plans import registry
from foliospark.streaming import watch

BASE = datetime(2024, 1, 1)
LIMITS = dict(retries=2, idle=100, backoff=1.5, most=200, hard=210)
SCHEMA = "chunk string, pass string, event_type string, ts timestamp, place long"


def replay(events, until, retries, idle, backoff, most, hard):
    """events: (seconds, kind) in order -> (attempt, outcome, at, idle limit, what follows) of the attempts that are over before `until`."""
    out, done, begun, last, limit = [], [], None, None, None

    def over(outcome, at):
        done.append(outcome)
        after = "done" if outcome == "success" else "retry" if len(done) <= retries else "failed"
        out.append((len(done), outcome, at, limit, after, passes.idle_seconds(idle, backoff, done.count("idle_timeout"), most) if after == "retry" else None, "|".join(done)))
        if after != "retry":
            done.clear()

    for at, kind in [*events, (until, "end")]:
        if begun is not None:
            due, how = min((begun + hard, "hard_timeout"), (last + limit, "idle_timeout"))
            if due < at:
                over(how, due)
                begun = None
        if kind == "pass_start":
            begun = last = at
            limit = passes.idle_seconds(idle, backoff, done.count("idle_timeout"), most)
        elif begun is not None and kind in ("pass_success", "pass_failure"):
            over("success" if kind == "pass_success" else "error", at)
            begun = None
        elif begun is not None:
            last = at
    return out


def some_events(seed):
    rng = random.Random(seed)
    out = {}
    for chunk in range(12):
        at, events = rng.randrange(50), []
        for _ in range(rng.randrange(3, 60)):
            at += rng.choice([5, 20, 60, 99, 100, 101, 160, 230, 700])
            events.append((at, rng.choice(["pass_start", "output", "output", "output", "pass_success", "pass_failure"])))
        out[f"chunk_{chunk}", "dialogue"] = events
    return out


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    watch.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def test_replayed_gaps_survive_a_restart(rocksdb, tmp_path):
    """Three files, a new query on the same checkpoint for each; the last event of another key moves the watermark past all limits."""
    spark, events = rocksdb, some_events(3)
    end = max(e[-1][0] for e in events.values()) + 5000
    rows = sorted([(at, c, p, kind) for (c, p), es in events.items() for at, kind in es])
    want = sorted([(c, p, *r) for (c, p), es in events.items() for r in replay(es, end, **LIMITS)], key=str)
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :], [(end, "z", "z", "output")], [(end + 1, "z", "z", "output")]]
    for n, part in enumerate(parts):
        frame = spark.createDataFrame([(c, p, kind, BASE + timedelta(seconds=at), i) for i, (at, c, p, kind) in enumerate(part)], SCHEMA)
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "n=*")).withWatermark("ts", "0 seconds")
        got = watch.watched(stream, ["chunk", "pass"], limits=watch.Limits(**LIMITS), clock="event", place="place")
        q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    seconds = ((F.unix_millis("at") / 1000) - F.unix_seconds(F.lit(BASE))).cast("int").alias("at")
    back = spark.read.parquet(str(tmp_path / "out")).select("chunk", "pass", "attempt", "outcome", seconds, "idle_s", "after", "next_idle_s", "outcomes").collect()
    assert sorted([tuple(r) for r in back], key=str) == want
    assert {"idle_timeout", "hard_timeout", "success", "error"} <= {r.outcome for r in back} and {r.idle_s for r in back} == {100, 150, 200}


def test_a_live_stream_times_out_by_the_clock(rocksdb, tmp_path):
    spark = rocksdb
    put = lambda n, rows: spark.createDataFrame([(c, "structure", k, BASE, 0) for c, k in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    put(0, [("a", "pass_start"), ("b", "pass_start"), (None, "pass_start")])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "n=*"))
    got = watch.watched(stream, ["chunk", "pass"], limits=watch.Limits(retries=0, idle=8, hard=600))
    q = got.writeStream.format("memory").queryName("watched").trigger(processingTime="500 milliseconds").start()
    try:
        began = time.time()
        while not any(p["numInputRows"] for p in q.recentProgress) and time.time() - began < 60:
            time.sleep(0.2)
        put(1, [("b", "pass_success")])
        while spark.table("watched").count() < 2 and time.time() - began < 90:
            time.sleep(0.5)
        assert {(r.chunk, r.outcome, r.after) for r in spark.table("watched").collect()} == {("a", "idle_timeout", "failed"), ("b", "success", "done")}
    finally:
        q.stop()


class Handle:
    """A key's state that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += name != "getValueState"
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return self if name == "getValueState" else self.value

        return call


def test_state_is_asked_once_a_batch_however_many_events_a_key_has():
    handle, times = Handle(), type("Times", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    w = watch.Watch(["k"], watch.Limits(**LIMITS), "event")
    w.init(handle)
    events = [{"event_type": kind, "_micros": i * 1_000_000, "_place": i} for i, kind in enumerate(["pass_start", "output", "pass_failure"] * 500 + ["pass_start"])]
    out = list(w.handleInputRows(("a",), iter(events), times))
    assert len(out) == 500 and handle.calls <= 4 and handle.timers == {1_600_000}
    assert [r.after for r in out[:3]] == ["retry", "retry", "failed"] and out[2].outcomes == "error|error|error"


def test_no_limits_and_a_wrong_clock(spark):
    assert watch.Limits(idle=0, hard=0).due(0, 0, 0) is None and watch.Limits().due(0, 720_000, 180) == (900_000, "hard_timeout")
    with pytest.raises(ValueError, match="clock"):
        watch.watched(spark.createDataFrame([], SCHEMA), ["chunk"], clock="wall")


def test_query(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.expr(registry.WATCHED), F.unix_millis(F.col("ts").cast("timestamp")) / 1000).orderBy("ts", "event_id").collect()
    by_user = {}
    for user, kind, at in rows:
        by_user.setdefault(user, []).append((at, kind))
    until = max(at for _, _, at in rows)
    want = sorted([(u, *r) for u, es in by_user.items() for r in replay(es, until, **registry.WATCH_LIMITS)], key=str)
    got = registry.watched_passes(spark, data).select("user_id", "attempt", "outcome", F.unix_millis("at") / 1000, "idle_s", "after", "next_idle_s", "outcomes").collect()
    assert sorted([tuple(r) for r in got], key=str) == want and len({r.outcome for r in got}) >= 3
