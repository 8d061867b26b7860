"""Jobs as append-only events, and the latest state as a view over them.

An action is a function from state to state. A block of a job's events folds to the table old state -> new state, and such tables compose in
any grouping. So a job's history splits over tasks: blocks of 2^shift places compose to blocks of blocks, and so on up; the states in which
blocks are entered then come down the same levels, and every block replays its own events. An action that the state doesn't allow changes
nothing and is listed.

Nulls, ties and odd rows: events without a job, place or known action don't count; events at one place go by action; a repeated
event is an event of its own; a job without events is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import let
from foliospark.operators import jobs, scans

#: The state of a job that doesn't exist, and all states in the order of a table's entries.
NONE = "none"
STATES = (NONE, *jobs.STATUSES)
_LIVE = ("running", "pause_requested", "cancel_requested")
#: action -> {state: next state}; a state that isn't there doesn't allow the action.
ACTIONS = {
    "create": {NONE: "queued"},
    "claim": {"queued": "running"},
    "pause": {"queued": "paused", "paused": "paused", "running": "pause_requested", "pause_requested": "pause_requested", "cancel_requested": "pause_requested"},
    "cancel": {"queued": "cancelled", "paused": "cancelled", "running": "cancel_requested", "pause_requested": "cancel_requested", "cancel_requested": "cancel_requested"},
    "run": {s: "queued" for s in ("paused", *jobs.TERMINAL)},
    "stopped": {"pause_requested": "paused", "cancel_requested": "cancelled"},
    "succeed": {s: "succeeded" for s in _LIVE},
    "fail": {s: "failed" for s in _LIVE},
    "recover": {"running": "queued"},
    "delete": {s: NONE for s in jobs.STATUSES},
}


def table_of(action: str, actions: dict = ACTIONS) -> list[int]:
    """For each state its number after the action; the same number where the action isn't allowed."""
    return [STATES.index(actions[action].get(s, s)) for s in STATES]


def _tables(actions: dict) -> tuple[Column, Column]:
    """Maps action -> table and action -> which states allow it."""
    pick = lambda f: F.create_map(*[x for a in actions for x in (F.lit(a), F.array(*[F.lit(v) for v in f(a)]))])
    return pick(lambda a: table_of(a, actions)), pick(lambda a: [s in actions[a] for s in STATES])


def _then(first: Column, second: Column) -> Column:
    """The table of one after the other."""
    return F.transform(first, lambda s: F.get(second, s))


def _identity() -> Column:
    return F.array(*[F.lit(i) for i in range(len(STATES))])


def replayed(events: DataFrame, job: str = "job_id", place: str = "seq", action: str = "action", shift: int = scans.SHIFT, actions: dict = ACTIONS) -> DataFrame:
    """(job, place, action, before, after, legal) of every event that counts."""
    table, allowed = _tables(actions)
    own = events.where(F.col(job).isNotNull() & F.col(place).isNotNull() & F.col(action).isin(*actions)).select(F.col(job).alias("job"), F.col(place).cast("bigint").alias("place"), F.col(action).alias("action"))
    levels = scans.levels_of(own, "place", shift=shift)
    held = own.groupBy("job", scans.block_of("place", shift, levels == 1).alias("b0")).agg(F.array_sort(F.collect_list(F.struct("place", "action"))).alias("events"))
    fold = lambda rows, get: F.aggregate(rows, _identity(), lambda acc, r: _then(acc, get(r)))
    tables = [held.select("job", F.col("b0").alias("b"), fold(F.col("events"), lambda e: F.element_at(table, e["action"])).alias("t"))]
    gathered = []
    for level in range(1, levels):
        above = tables[-1].groupBy("job", scans.block_of("b", shift, level == levels - 1).alias("p")).agg(F.array_sort(F.collect_list(F.struct("b", "t"))).alias("parts"))
        gathered.append(above)
        tables.append(above.select("job", F.col("p").alias("b"), fold(F.col("parts"), lambda r: r["t"]).alias("t")))
    entered = tables[-1].select("job", "b", F.lit(0).alias("state"))
    for above in reversed(gathered):
        # Each part is entered in the state that the parts before it leave.
        walked = F.aggregate("parts", F.struct(F.col("state").alias("s"), F.array().cast("array<struct<b:bigint,state:int>>").alias("out")), lambda acc, r: F.struct(F.get(r["t"], acc["s"]).alias("s"), F.array_append(acc["out"], F.struct(r["b"].alias("b"), acc["s"].alias("state"))).alias("out")), lambda acc: acc["out"])
        met = above.join(entered.withColumnRenamed("b", "p"), ["job", "p"])
        entered = met.select("job", F.explode(walked).alias("e")).select("job", "e.b", "e.state")
    own_entry = held.join(entered.withColumnRenamed("b", "b0"), ["job", "b0"])
    OUT = "array<struct<place:bigint,action:string,before:int,after:int,legal:boolean>>"

    def step(acc, e):
        s = acc["s"]
        return let(F.get(F.element_at(table, e["action"]), s), lambda to: F.struct(to.alias("s"), F.array_append(acc["out"], F.struct(e["place"].alias("place"), e["action"].alias("action"), s.alias("before"), to.alias("after"), F.get(F.element_at(allowed, e["action"]), s).alias("legal"))).alias("out")))

    each = own_entry.select("job", F.explode(F.aggregate("events", F.struct(F.col("state").alias("s"), F.array().cast(OUT).alias("out")), step, lambda acc: acc["out"])).alias("e")).select("job", "e.*")
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col(c) + 1).alias(c)
    return each.select(F.col("job").alias(job), F.col("place").alias(place), F.col("action").alias(action), name("before"), name("after"), "legal")


def latest(events: DataFrame, job: str = "job_id", place: str = "seq", action: str = "action", shift: int = scans.SHIFT, actions: dict = ACTIONS) -> DataFrame:
    """(job, status, events, illegal, updated): each job's state after its events; deleted jobs have the state `none`."""
    return replayed(events, job, place, action, shift, actions).groupBy(job).agg(F.max_by("after", F.struct(place, action)).alias("status"), F.count("*").alias("events"), F.count_if(~F.col("legal")).alias("illegal"), F.max(place).alias("updated"))


def illegal(events: DataFrame, job: str = "job_id", place: str = "seq", action: str = "action", shift: int = scans.SHIFT, actions: dict = ACTIONS) -> DataFrame:
    """(job, place, action, before): the actions that weren't allowed where they came."""
    return replayed(events, job, place, action, shift, actions).where("NOT legal").drop("after", "legal")
