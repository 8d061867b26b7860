"""Job tables and run logs as data: latest states, transitions, claims and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T

# Job states, in the order of the summary, and the passes of a chunk.
STATUSES = ("queued", "running", "paused", "pause_requested", "cancel_requested", "succeeded", "failed", "cancelled")
TERMINAL = ("succeeded", "failed", "cancelled")
PRIORITY = ("running", "pause_requested", "cancel_requested", "queued", "paused", "succeeded")
PASSES = ("structure", "dialogue", "entities", "dossiers")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def status_counts(jobs: DataFrame, status: str, statuses: tuple = STATUSES) -> DataFrame:
    """(status, n) with zeros, and a total row."""
    spark = jobs.sparkSession
    wanted = spark.createDataFrame([(s,) for s in statuses], "status string")
    counts = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    each = wanted.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return each.union(jobs.agg(F.lit("total").alias("status"), F.count("*").alias("n")).select("status", "n"))


def transition(status: Column, action: str) -> Column:
    """The state after cancel, pause or run."""
    if action == "run":
        return F.when((status == "paused") | status.isin(*TERMINAL), "queued").otherwise(status)
    now, asked = {"cancel": ("cancelled", "cancel_requested"), "pause": ("paused", "pause_requested")}[action]
    return F.when(status.isin(*TERMINAL), status).when(status.isin("queued", "paused"), now).otherwise(asked)


def stale(jobs: DataFrame, status: str, claimed_at: Column, now: Column, seconds: int) -> DataFrame:
    """Running jobs claimed `seconds` or longer ago; jobs without a claim never recover."""
    return jobs.where((F.col(status) == "running") & claimed_at.isNotNull() & (claimed_at <= now - F.make_dt_interval(secs=F.lit(seconds))))


def claim(jobs: DataFrame, status: str, order: list, include: Column | None = None, exclude: Column | None = None) -> DataFrame:
    """The oldest queued job that passes the filters. Taking the lock is the store's business."""
    own = jobs.where(F.col(status) == "queued")
    own = own.where(include) if include is not None else own
    return (own.where(~exclude) if exclude is not None else own).orderBy(*order).limit(1)


def upsert(rows: DataFrame, keys: list[str], order: str, kept: str, values: list[str]) -> DataFrame:
    """One row per key (null keys equal): created from the first row, `kept` the last value that isn't null, the values of the last row."""
    return rows.groupBy(*keys).agg(F.min(order).alias("created"), F.max(order).alias("updated"), F.max_by(kept, F.when(F.col(kept).isNotNull(), F.col(order))).alias(kept), *[F.max_by(v, order).alias(v) for v in values])


#: Fields of the run log and what they are, besides the keys and the order.
EVENT = {"event_type": "string", "chunk": "string", "pass": "string", "step": "string", "model": "string", "attempt": "int", "idle_timeout_s": "double", "idle_timeout_failures_for_pass": "int", "reported_tps": "double", "estimated_tps": "double", "message": "string"}


def since(events: DataFrame, ts: str, lower: Column | None) -> DataFrame:
    """Events from a time on; those without a time stay."""
    return events if lower is None else events.where(F.col(ts).isNull() | (F.col(ts) >= lower))


def progress(events: DataFrame, keys: list[str], order: str, lower: Column | None = None, ts: str | None = None) -> DataFrame:
    """A row per key from events: counts, the last event, and the last value of each field that isn't null.

    order tells which event is the last: a place in the log, or a time, by which events without one can't be. ts is the events' time,
    for `lower` and last_event_at; order itself where it isn't given. Of EVENT those fields count that the events have.
    """
    ts = ts or order
    own = since(events, ts, lower)
    has = set(own.columns)
    at = F.col(order)
    last = lambda name, where=None: F.max_by(name, F.when(F.col(name).isNotNull() if where is None else where, at))
    text = lambda name: last(name, F.coalesce(F.col(name) != "", F.lit(False)))
    values = {
        "current_step": ("step", text), "current_model": ("model", text), "current_attempt": ("attempt", last), "current_idle_timeout_s": ("idle_timeout_s", last),
        "idle_backoffs": ("idle_timeout_failures_for_pass", last), "reported_tps": ("reported_tps", last), "estimated_tps": ("estimated_tps", last),
    }
    return own.groupBy(*keys).agg(
        F.count_if(F.col("event_type") == "chunk_success").alias("chunks_completed"),
        F.count_if(F.col("event_type") == "chunk_failure").alias("chunks_failed"),
        F.max_by("event_type", order).alias("last_event_type"),
        F.max_by(ts, order).alias("last_event_at"),
        last("pass", F.col("pass").isin(*PASSES)).alias("current_pass"),
        *[how(field).alias(name) for name, (field, how) in values.items() if field in has],
    )


def progress_state(events: DataFrame, keys: list[str], order: str, ts: str | None = None) -> DataFrame:
    """progress() in a form that merges: counts, and for each value that it keeps the last (order, value); order is an event's place in the log."""
    has, at, ts = set(events.columns), F.col(order), ts or order
    last = lambda name, where: F.max(F.when(where & at.isNotNull(), F.struct(at.alias("at"), F.col(name).alias("v"))))
    some = {f: F.col(f).isNotNull() for f in ("model", "attempt", "idle_timeout_s", "idle_timeout_failures_for_pass", "reported_tps", "estimated_tps")}
    some |= {f: F.coalesce(F.col(f) != "", F.lit(False)) for f in ("step", "model")} | {"pass": F.col("pass").isin(*PASSES)}
    return events.groupBy(*keys).agg(
        F.count_if(F.col("event_type") == "chunk_success").alias("chunks_completed"), F.count_if(F.col("event_type") == "chunk_failure").alias("chunks_failed"),
        last("event_type", F.lit(True)).alias("last_event_type"), last(ts, F.lit(True)).alias("last_event_at"), *[last(f, some[f]).alias(name) for name, f in LAST.items() if f in has],
    )


#: What progress() calls the last value of a field.
LAST = {
    "current_pass": "pass", "current_step": "step", "current_model": "model", "current_attempt": "attempt", "current_idle_timeout_s": "idle_timeout_s",
    "idle_backoffs": "idle_timeout_failures_for_pass", "reported_tps": "reported_tps", "estimated_tps": "estimated_tps",
}


def merged_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """One progress_state() per key of several, in any grouping."""
    counts = ("chunks_completed", "chunks_failed")
    return states.groupBy(*keys).agg(*[(F.sum if c in counts else F.max)(c).alias(c) for c in states.columns if c not in keys])


def shown_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """progress() from a merged state."""
    return states.select(*keys, *[(F.col(c) if c.startswith("chunks_") else F.col(f"{c}.v")).alias(c) for c in states.columns if c not in keys])


def chunk_bitmaps(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, bitmap): which chunks, by their numbers, were completed, however often. Bitmaps of several batches merge: see chunks_done()."""
    number = T.chunk_index(F.col("chunk"))
    own = events.where("event_type = 'chunk_success'").where(number.isNotNull()).select(*keys, number.alias("_n"))
    return own.groupBy(*keys, F.bitmap_bucket_number("_n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bitmap"))


def chunks_done(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunks_completed): how many different chunks are completed, from bitmaps of any number of batches. Chunks without a number don't count."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("chunks_completed"))


def current_chunk(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, current_chunk): the latest started chunk whose last event isn't its end, else the latest started."""
    chunks = events.where(F.col("chunk") != "").groupBy(*keys, "chunk").agg(F.max(F.when(F.col("event_type") == "chunk_start", F.col(order))).alias("started"), F.max_by(F.coalesce("event_type", F.lit("")), order).alias("last"))
    open_ = ~F.col("last").isin("chunk_success", "chunk_failure")
    return chunks.where("started IS NOT NULL").groupBy(*keys).agg(F.max_by("chunk", F.struct(open_.alias("o"), F.col("started").alias("s"))).alias("current_chunk"))


def full_progress(events: DataFrame, runs: DataFrame, keys: list[str], order: str, ts: str | None = None, lower: str | None = None, recent: int = 8) -> DataFrame:
    """progress() of each of the runs(keys, chunks_total), with the current chunk and pass, their places and percents, and the last events.

    lower: a column of runs, the time before which a run's events don't count. Runs without events have zeros, nulls and no events.
    chunk_percent counts from the current chunk's number (its trailing digits and one), else from the chunks that are done.
    """
    own = events
    if lower is not None:
        own = events.join(runs.select(*keys, F.col(lower).alias("_lower")), keys).where(F.col(ts or order).isNull() | F.col("_lower").isNull() | (F.col(ts or order) >= F.col("_lower"))).drop("_lower")
    fields = [c for c in (ts or order, "event_type", "chunk", "pass", "step", "message") if c in own.columns]
    # Spark keeps the last `recent` rows of a key before the shuffle.
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    last = own.withColumn("_n", place).where(F.col("_n") <= recent).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("_n"), F.struct(*fields).alias("e")))).alias("_r"))
    last = last.select(*keys, F.transform("_r", lambda r: r["e"]).alias("recent_events"))
    got = runs.select(*keys, "chunks_total").join(progress(own, keys, order, ts=ts), keys, "left").join(current_chunk(own, keys, order), keys, "left").join(last, keys, "left")
    got = got.na.fill(0, [c for c in ("chunks_completed", "chunks_failed", "idle_backoffs", "chunks_total") if c in got.columns])
    done, total = F.col("chunks_completed"), F.col("chunks_total")
    number = F.coalesce(F.nullif(T.chunk_index(F.col("current_chunk")), F.lit(0)), done + 1)
    index = F.when(F.col("current_chunk").isNotNull(), number).when((done > 0) & (total > 0) & (done >= total), total)
    at = F.nullif(F.array_position(F.array(*[F.lit(p) for p in PASSES]), F.col("current_pass")), F.lit(0))
    percent = lambda part, whole: T.rounded(part.cast("double") / whole * 100, 1)
    out = got.withColumn("current_chunk_index", index).withColumn("current_pass_index", at)
    begun = F.col("current_chunk").isNotNull() & (F.col("current_chunk_index") != 0)
    chunk_percent = F.when(total > 0, F.when(begun, percent(F.col("current_chunk_index") - 1, total)).otherwise(percent(done, total))).otherwise(0.0)
    pass_percent = F.coalesce(percent(F.col("current_pass_index") - 1, F.lit(len(PASSES))), F.lit(0.0))
    return out.withColumn("chunk_percent", chunk_percent).withColumn("pass_percent", pass_percent)


def incomplete(inputs: DataFrame, outputs: DataFrame, key: str, passes: tuple = (*PASSES, "timing")) -> DataFrame:
    """Inputs without a complete set of outputs(key, pass)."""
    done = outputs.where(F.col("pass").isin(*passes)).groupBy(key).agg(F.countDistinct("pass").alias("n")).where(F.col("n") == len(passes))
    return inputs.join(done, key, "left_anti")


def import_identity(taken: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """(name, new_name): the name itself if it is free, else the first free <name>_imported_N, N from 2."""
    pattern = r"^(.*)_imported_([0-9]+)$"
    used = taken.select(F.col(name).alias("_t")).distinct()
    numbers = used.where(F.col("_t").rlike(pattern)).select(F.regexp_extract("_t", pattern, 1).alias(name), F.regexp_extract("_t", pattern, 2).cast("bigint").alias("n")).where("n >= 2").distinct()
    # The first gap: numbers in order from 2 are in their place until one is missing.
    place = numbers.withColumn("r", F.row_number().over(W.partitionBy(name).orderBy("n")) + 1)
    gap = place.groupBy(name).agg((F.coalesce(F.max(F.when(F.col("n") == F.col("r"), F.col("n"))), F.lit(1)) + 1).alias("free"))
    own = asked.select(name).distinct().join(used, F.col(name) == F.col("_t"), "left").join(gap, name, "left")
    return own.select(name, F.when(F.col("_t").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("_imported_"), F.coalesce("free", F.lit(2)).cast("string"))).alias("new_name"))
