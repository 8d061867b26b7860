"""The run log as a stream: JSON lines to events, progress per run, events once only, and quiet runs or workers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators import jobs

FIELDS = {"run": "string", "timestamp": "string", **jobs.EVENT}


def events(lines: DataFrame, line: str = "value", keep: tuple = ()) -> DataFrame:
    """Events (FIELDS, the time as ts) of a batch or a stream of JSON lines. Blank and malformed lines and lines that aren't objects go; a bad time is null."""
    doc = F.try_parse_json(F.col(line))
    own = lines.select(doc.alias("v"), *keep).where("schema_of_variant(v) LIKE 'OBJECT%'")
    got = own.select(*[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()], *keep)
    return got.withColumn("ts", F.expr("try_to_timestamp(timestamp)")).drop("timestamp")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log's files with `place`, the order of the lines, by the files' names and then as they are written; for jobs.full_progress()."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"))
    return events(lines, keep=("place",))


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)


def progress(stream: DataFrame, keys: list[str], order: str = "ts", lower: Column | None = None) -> DataFrame:
    """jobs.progress() over a stream, for update or complete mode. State is one row per run, however long its log."""
    return jobs.progress(stream, keys, order, lower)


def once(stream: DataFrame, ids: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """An extension: each event once if its repeats come within `late`; the state forgets older ids."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def windowed_counts(stream: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension: counts per tumbling window; events later than `late` are dropped."""
    got = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), *keys, "n")


def quiet(stream: DataFrame, key: str, ts: str = "ts", after: int = 600) -> DataFrame:
    """(key, state, last): `alive` rows as events come, and a `quiet` row once the watermark is `after` seconds past a key's last event.

    Rows without a key or a time don't count. The stream must have a watermark on `ts`.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "state": ["quiet"], "last": [pd.Timestamp(last, unit="ms")]})
            return
        newest = max(int(pdf[ts].max().timestamp() * 1000) for pdf in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        # An event that is already too old for its timer goes quiet with the next watermark.
        state.setTimeoutTimestamp(max(last + after * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]], "state": ["alive"], "last": [pd.Timestamp(last, unit="ms")]})

    kind = stream.schema[key].dataType.simpleString()
    own = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts)
    return own.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, state string, last timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def append(stream: DataFrame, path: str, checkpoint: str, by: str | None = None, available_now: bool = True) -> StreamingQuery:
    """The stream as JSON lines in a folder, each event written once. The checkpoint is in a folder that all nodes share."""
    out = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    out = out.partitionBy(by) if by else out
    return (out.trigger(availableNow=True) if available_now else out).start()
