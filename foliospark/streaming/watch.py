"""Live passes under watch: idle and hard timeouts, retries and their growing idle limits as the state of a stream.

A key's attempts begin with a `pass_start`; any later event of the key is activity; `pass_success` and `pass_failure` end the attempt. It has
timed out once nothing came for its idle limit, or once its hard limit has passed since its start; of both the earlier counts, at equal times
the hard one. Only idle timeouts make the next attempt's limit longer, by the rule of passes.idle_seconds(). Events between attempts
count for nothing. A key's state is one value, the open attempt and how the attempts before it ended: it is read and written once for all of a
batch's events of the key, as each access is a message to the JVM. A timer stands at the open attempt's next limit. The state lives in RocksDB
and a checkpoint, so that a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators import passes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "attempt int, outcome string, at bigint, idle_s int, after string, next_idle_s int, outcomes string"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that such a stream needs, for queries that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Limits:
    """What an attempt may take, in seconds; zero is no limit."""

    def __init__(self, retries: int = 1, idle: float = 180, backoff: float = 1.5, most: float = 600, hard: float = 900):
        self.retries, self.idle, self.backoff, self.most, self.hard = retries, idle, backoff, most, hard

    def idle_after(self, timeouts: int) -> int:
        return passes.idle_seconds(self.idle, self.backoff, timeouts, self.most) if self.idle > 0 else 0

    def due(self, begun: int, last: int, idle: int) -> tuple[int, str] | None:
        """When the open attempt times out if nothing more comes, and how."""
        ways = [(begun + int(self.hard * 1000), "hard_timeout")] * (self.hard > 0) + [(last + idle * 1000, "idle_timeout")] * (idle > 0)
        return min(ways, key=lambda w: w[0]) if ways else None


class Watch(StatefulProcessor):
    """clock: `processing` for live streams, by when events arrive, or `event` for replayed ones, by their own times."""

    def __init__(self, keys: list[str], limits: Limits, clock: str):
        self.keys, self.limits, self.clock = keys, limits, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # begun is -1 where no attempt is open, timer -1 where none stands; over: the ends of the attempts so far, joined by bars.
        self.state = handle.getValueState("state", "begun bigint, last bigint, idle int, timer bigint, over string")
        self.row = Row(*self.keys, *(c.split()[0] for c in OUT.split(", ")))

    def _read(self) -> tuple[tuple | None, int, list[str]]:
        """(begun, last, idle) of the open attempt, its timer and how those before it ended."""
        begun, last, idle, timer, over = self.state.get() or (-1, -1, 0, -1, "")
        return (begun, last, idle) if begun >= 0 else None, timer, over.split("|") if over else []

    def _write(self, got: tuple | None, timer: int, done: list[str], now: int) -> None:
        """The state, and the timer where the open attempt is due: timers that are past at once would be lost."""
        due = self.limits.due(*got) if got else None
        wanted = max(due[0], now + 1) if due else -1
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wanted >= 0:
                self.handle.registerTimer(wanted)
        if got or done:
            self.state.update((*(got or (-1, -1, 0)), wanted, "|".join(done)))
        else:
            self.state.clear()

    def _idle(self, done: list[str]) -> int:
        return self.limits.idle_after(done.count("idle_timeout"))

    def _close(self, key: tuple, outcome: str, at: int, idle: int, done: list[str]) -> Row:
        done.append(outcome)
        after = "done" if outcome == "success" else "retry" if len(done) <= self.limits.retries else "failed"
        row = self.row(*key, len(done), outcome, at, idle, after, self._idle(done) if after == "retry" else None, "|".join(done))
        if after != "retry":
            done.clear()
        return row

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        live = self.clock == "processing"
        now = timerValues.getCurrentProcessingTimeInMs() if live else timerValues.getCurrentWatermarkInMs()
        held = sorted(((r["_micros"], r["_place"], r["event_type"]) for r in rows), key=lambda r: r[:2])
        got, timer, done = self._read()
        for micros, _, kind in held:
            at = now if live else micros // 1000
            if got:
                begun, last, idle = got
                due = self.limits.due(begun, last, idle)
                if due and due[0] < at:
                    yield self._close(key, due[1], due[0], idle, done)
                    got = None
                elif kind in ("pass_success", "pass_failure"):
                    yield self._close(key, "success" if kind == "pass_success" else "error", at, idle, done)
                    got = None
                    continue
                elif kind != "pass_start":
                    got = (begun, max(last, at), idle)
                    continue
            if kind == "pass_start":  # while an attempt is open, that attempt starts anew
                got = (at, at, self._idle(done))
        self._write(got, timer, done, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        got, timer, done = self._read()
        due = self.limits.due(*got) if got else None
        if due and timer == expiredTimerInfo.getExpiryTimeInMs():
            row = self._close(key, due[1], due[0], got[2], done)
            self._write(None, -1, done, 0)
            yield row

    def close(self) -> None:
        pass


def watched(stream: DataFrame, keys: list[str], ts: str = "ts", limits: Limits | None = None, clock: str = "processing", place: str | None = None) -> DataFrame:
    """(keys, attempt, outcome, at, idle_s, after, next_idle_s, outcomes): a row when an attempt ends, by success, error, idle_timeout or hard_timeout.

    after is done, retry (with the next attempt's idle limit) or failed. Rows with a null key, or by event time without a time, don't count; with
    clock `event` the stream must have a watermark on ts, and events at one time go by `place`. Append mode.
    """
    if clock not in ("processing", "event"):
        raise ValueError("clock is processing or event")
    own = stream.where(F.col("event_type").isNotNull())
    for k in [*keys, *([ts] if clock == "event" else [])]:
        own = own.where(F.col(k).isNotNull())
    last = F.lit((1 << 63) - 1)
    micros, at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), last), F.col(place).cast("bigint") if place else F.lit(0).cast("bigint")
    own = own.select(*keys, "event_type", F.col(ts).alias("_at"), micros.alias("_micros"), F.coalesce(at, last).alias("_place"))
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    got = own.groupBy(*keys).transformWithState(Watch(keys, limits or Limits(), clock), f"{kinds}, {OUT}", "append", "ProcessingTime" if clock == "processing" else "EventTime")
    return got.select(*[F.timestamp_millis("at").alias("at") if c == "at" else c for c in got.columns])
