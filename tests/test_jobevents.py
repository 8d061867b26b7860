"""Job events against a sequential replay, and the mergeable progress and bitmaps against whole batches."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import jobevents, jobs

SCHEMA = "job_id string, seq long, action string"


def replay(rows):
    out, state = [], {}
    for job, seq, action in sorted((r for r in rows if None not in r and r[2] in jobevents.ACTIONS), key=lambda r: (r[0], r[1], r[2])):
        before = state.get(job, "none")
        after = jobevents.ACTIONS[action].get(before)
        state[job] = after or before
        out.append((job, seq, action, before, state[job], after is not None))
    return out, state


@pytest.mark.parametrize("shift", [2, 3, 10])
def test_replay(spark, shift):
    """One job with most of the events, negative and repeated places, nulls and unknown actions."""
    rng = random.Random(shift)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, *range(-20, 400)]), rng.choice([*jobevents.ACTIONS, "claim", "create", "nonsense", None])) for _ in range(500)]
    events = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", place int")
    want, state = replay(rows)
    assert sorted(map(tuple, jobevents.replayed(events, shift=shift).collect())) == sorted(want)
    got = {r.job_id: r for r in jobevents.latest(events, shift=shift).collect()}
    assert {j: r.status for j, r in got.items()} == state and all(r.illegal == sum(w[0] == j and not w[5] for w in want) for j, r in got.items())
    assert sorted(map(tuple, jobevents.illegal(events, shift=shift).collect())) == sorted(w[:4] for w in want if not w[5])


def test_tables_compose_in_any_grouping():
    rng = random.Random(1)
    tables = [jobevents.table_of(rng.choice([*jobevents.ACTIONS])) for _ in range(9)]
    then = lambda a, b: [b[s] for s in a]
    assert then(then(tables[0], tables[1]), tables[2]) == then(tables[0], then(tables[1], tables[2]))


def test_actions_agree_with_the_requests_of_the_job_table(spark):
    frame = spark.createDataFrame([(s,) for s in jobs.STATUSES], "s string")
    for action in ("cancel", "pause", "run"):
        for r in frame.select("s", jobs.transition(F.col("s"), action).alias("to")).collect():
            assert jobevents.ACTIONS[action].get(r.s, r.s) == r.to


def test_empty(spark):
    assert jobevents.latest(spark.createDataFrame([], SCHEMA)).collect() == []


EVENTS = "run string, place long, event_type string, chunk string, pass string, model string, reported_tps double"


def some_events(n, seed):
    rng = random.Random(seed)
    kinds = ["chunk_start", "chunk_success", "chunk_success", "chunk_failure", "pass_start"]
    return [(rng.choice(["a", "b", "c", None]), i, rng.choice(kinds), rng.choice([f"chunk_{rng.randrange(30):03d}", "intro", None]), rng.choice(["dialogue", "entities", "odd", None]), rng.choice(["m", "", None]), rng.choice([None, 1.5, 2.5])) for i in range(n)]


def test_merged_states_are_the_progress_of_all(spark):
    rows = some_events(300, 2)
    frame = spark.createDataFrame(rows, EVENTS)
    parts = [jobs.progress_state(frame.where(F.col("place") % 3 == k), ["run"], "place") for k in range(3)]
    merged = jobs.merged_state(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["run"])
    want = jobs.progress(frame, ["run"], "place")
    assert sorted(map(str, jobs.shown_state(merged, ["run"]).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_each_chunk_counts_once(spark):
    rows = some_events(300, 4) + [("a", 900, "chunk_success", "chunk_99999", None, None, None)]
    frame = spark.createDataFrame(rows, EVENTS)
    halves = [jobs.chunk_bitmaps(frame.where(F.col("place") < 150), ["run"]), jobs.chunk_bitmaps(frame.where(F.col("place") >= 150), ["run"])]
    got = {r.run: r.chunks_completed for r in jobs.chunks_done(halves[0].unionByName(halves[1]), ["run"]).collect()}
    done = {(r[0], int(r[3][6:])) for r in rows if r[2] == "chunk_success" and (r[3] or "").startswith("chunk_")}
    assert got == {run: sum(d[0] == run for d in done) for run in {d[0] for d in done}}
