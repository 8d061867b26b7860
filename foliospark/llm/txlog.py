"""Reassembly of transaction logs: which change is committed, rolled back or aborted, and what a shared store holds after each epoch of commits.

A log is rows (stream, pos, op, key, live, value) with op in change, savepoint, rollback, commit, abort. Each stream runs successive
transactions that a commit, an abort or the log's end (an abort) closes. A savepoint raises the transaction's height by one; a rollback
goes back to the latest savepoint and keeps it, or by `back` savepoints further down where the log has that column, and undoes every
change that stands at the height it reaches or above. So a change is undone by the first later rollback of its transaction that
reaches down to the change's height.

Positions are cut into blocks of 2^SHIFT, blocks into blocks of blocks, and so on. A change looks for its rollback inside its own block;
one that finds none searches the blocks' minima, up and then down the levels, for the first block that dips to its height, and finishes
inside that block. What precedes a row (open transaction, height, number of commits) is summed up by the same blocks. So no task holds
more than a block's rows or 2^SHIFT summaries of a stream, however long a stream or a transaction is; nothing is broadcast.

Nulls, ties and odd rows: rows without a position are no log records; a null stream is one stream; a repeated position is ordered by op,
key and value, and each repeat is a record of its own; an empty log has no rows. A change with a null value deletes its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import cut, drop
from foliospark.operators import scans
from foliospark.operators.scans import SHIFT, block_of, preceded

#: Commits of an epoch.
EPOCH = 16
#: Fixed values of the query: what the remainders of a record's hash by MOD mean, and how many keys there are.
MOD, KEYS = 41, 3000
OPS = ((1, "commit"), (2, "abort"), (4, "savepoint"), (6, "rollback"))

END = (1 << 63) - 1


def levels_of(log: DataFrame, shift: int = SHIFT) -> int:
    """How many levels of blocks cover all positions and as many epochs as there can be."""
    return scans.levels_of(log, "pos", shift=shift)


def _first_dips(asked: DataFrame, lows: DataFrame, levels: int, shift: int) -> DataFrame:
    """For rows (stream, txn, block, height): `found`, the first later block of the transaction whose minimum in lows (stream, txn, block, low) is at
    most height. Rows that find none are left out. Blocks are looked for among their siblings, then among their parents' siblings, and so on;
    from a parent that dips the search goes down to the first child that does."""
    at, minima, out = asked.withColumn("_own", F.col("block")), [lows], []

    def first(asks, level, after):
        """asks with the first sibling under `_in` that dips; after: only those behind the block `_at`."""
        siblings = minima[level].groupBy("stream", "txn", block_of("block", shift, level == levels - 2).alias("_in")).agg(F.sort_array(F.collect_list(F.struct("block", "low"))).alias("_all"))
        fits = lambda x: (x["low"] <= F.col("height")) & ((x["block"] > F.col("_at")) if after else F.lit(True))
        return asks.join(siblings.hint("merge"), ["stream", "txn", "_in"], "left").withColumn("_hit", F.get(F.filter("_all", fits), F.lit(0))["block"]).drop("_all", "_in")

    for level in range(levels - 1):
        here = first(at.withColumn("_at", F.col("block")).withColumn("_in", block_of("block", shift, level == levels - 2)), level, True)
        hit = here.where("_hit IS NOT NULL").withColumn("block", F.col("_hit")).drop("_hit", "_at")
        for down in range(level - 1, -1, -1):
            hit = first(hit.withColumn("_in", F.col("block")), down, False).withColumn("block", F.col("_hit")).drop("_hit")
        out.append(hit.select("stream", "txn", "height", F.col("_own").alias("block"), F.col("block").alias("found")))
        at = here.where("_hit IS NULL").withColumn("block", F.shiftright("block", shift)).drop("_hit", "_at")
        minima.append(minima[-1].groupBy("stream", "txn", F.shiftright("block", shift).alias("block")).agg(F.min("low").alias("low")))
    return reduce(DataFrame.unionByName, out)


def outcomes(log: DataFrame, levels: int | None = None, shift: int = SHIFT) -> DataFrame:
    """(stream, pos, key, live, value, outcome, by) of every change of the log: committed, rolled back or aborted, and the position of the record that did it, null at the log's end."""
    levels = levels or levels_of(log, shift)
    ties = ("op", "key", "value")
    closer = F.col("op").isin("commit", "abort")
    ended = preceded(log, ["stream"], "pos", {"_end": ("min", F.when(closer, F.struct("pos", "op")))}, levels, shift, ties, backwards=True)
    own = ended.where(~closer).withColumn("txn", F.coalesce("_end.pos", F.lit(END))).withColumn("_kind", F.coalesce("_end.op", F.lit("abort"))).drop("_end")
    group = ["stream", "txn"]
    back = F.coalesce("back", F.lit(0)).cast("bigint") if "back" in log.columns else F.lit(0).cast("bigint")
    rise = F.when(F.col("op") == "savepoint", F.lit(1).cast("bigint")).when(F.col("op") == "rollback", -back).otherwise(F.lit(0).cast("bigint"))
    own = preceded(own.withColumn("_rise", rise), group, "pos", {"_height": ("sum", F.col("_rise"))}, levels, shift, ties)
    if "back" in log.columns:  # a rollback beyond the first savepoint goes to the start: heights are taken from the lowest sum so far
        own = own.withColumn("_sum", F.col("_height") + F.col("_rise"))
        own = preceded(own, group, "pos", {"_low": ("min", F.col("_sum"))}, levels, shift, ties)
        own = own.withColumn("_height", F.col("_height") - F.least(F.lit(0), F.coalesce("_low", F.lit(0))))
    own = own.where("op <> 'savepoint'").withColumn("_reach", F.when(F.col("op") == "rollback", F.greatest(F.lit(0), F.col("_height") + F.col("_rise"))))
    own = cut(own.select(*group, "_kind", "pos", "op", "key", "live", "value", "_height", "_reach", block_of("pos", shift, levels == 1).alias("block")), "txlog-heights")

    # A rollback stands at each height it passes, of which there are no more in all than savepoints and rollbacks.
    passed = F.when(F.col("op") == "rollback", F.sequence("_reach", "_height")).otherwise(F.array("_height"))
    rows = own.withColumn("height", F.explode(passed)).drop("_height")
    w = Window.partitionBy(*group, "block", "height").orderBy(F.desc("pos"), *[F.desc(c) for c in ties]).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.min(F.when(F.col("op") == "rollback", F.col("pos"))).over(w)).where("op = 'change'")
    if levels > 1:
        back_rows = rows.where("op = 'rollback'")
        lows = back_rows.groupBy(*group, "block").agg(F.min("_reach").alias("low"))
        firsts = back_rows.groupBy(*group, F.col("block").alias("found"), "height").agg(F.min("pos").alias("_later"))
        inside = cut(inside, "txlog-inside")
        asked = inside.where("_in IS NULL").select(*group, "block", "height").distinct()
        later = _first_dips(asked, lows, levels, shift).join(firsts.hint("merge"), [*group, "found", "height"]).drop("found")
        inside_all = inside.join(later.hint("merge"), [*group, "block", "height"], "left").withColumn("_in", F.coalesce("_in", "_later"))
    else:
        inside_all = inside
    undone = F.col("_in").isNotNull()
    by = F.when(undone, F.col("_in")).otherwise(F.nullif("txn", F.lit(END)))
    out = cut(inside_all.select("stream", "pos", "key", "live", "value", F.when(undone, "rollback").otherwise(F.col("_kind")).alias("outcome"), by.alias("by")), "txlog-outcomes")
    drop(own, *([inside] if levels > 1 else []))
    return out


def states(log: DataFrame, changes: DataFrame, every: int = EPOCH, levels: int | None = None, shift: int = SHIFT) -> DataFrame:
    """(epoch, n_keys, total) after each epoch of `every` commits of the log: how many keys the store holds and the sum of their values, from outcomes().

    Only a transaction's last change of a key is applied, and only an epoch's last one counts; each key is compared with its own last
    epoch, and the differences are summed over the epochs.
    """
    levels = levels or levels_of(log, shift)
    commits = preceded(log.where("op = 'commit'").select("pos"), [], "pos", {"_rank": ("sum", F.lit(1).cast("bigint"))}, levels, shift)
    epochs = cut(commits.groupBy("pos").agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last")), "txlog-commits")
    number = lambda rank: (F.floor(rank / every) + 1).cast("bigint")
    ended = epochs.select(F.explode(F.sequence(number(F.col("_first")), number(F.col("_last")))).alias("epoch")).distinct()
    last = changes.where("outcome = 'commit'").groupBy("by", "key").agg(F.max(F.struct("pos", "live", "value")).alias("_c"))
    dated = last.join(epochs.select(F.col("pos").alias("by"), number(F.col("_first")).alias("epoch")).hint("merge"), "by")
    each = dated.groupBy("epoch", "key").agg(F.max(F.struct("by", "_c")).alias("_l")).select("epoch", "key", "_l._c.live", F.coalesce("_l._c.value", F.lit(0)).alias("value"))
    was = preceded(each, ["key"], "epoch", {"_was": ("max", F.struct("epoch", "live", "value"))}, levels, shift)
    here, before = F.col("live"), F.coalesce("_was.live", F.lit(False))
    gain = was.groupBy("epoch").agg(
        F.sum(here.cast("bigint") - before.cast("bigint")).alias("_n"),
        F.sum(F.when(here, F.col("value")).otherwise(0) - F.when(before, F.col("_was.value")).otherwise(0)).alias("_v"),
    )
    all_gains = ended.join(gain.hint("merge"), "epoch", "left").select("epoch", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_v", F.lit(0)).alias("_v"))
    run = preceded(all_gains, [], "epoch", {"_bn": ("sum", F.col("_n")), "_bv": ("sum", F.col("_v"))}, levels, shift)
    sums = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("bigint")
    return run.select("epoch", sums("_bn", "_n").alias("n_keys"), sums("_bv", "_v").alias("total"))


def records(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The log that documents stand for, by the query's hash of doc_id. A text is reduced to the CRC of `key:text` where it is read."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    meaning = reduce(lambda c, o: c.when(h % MOD <= o[0], o[1]), OPS, F).otherwise("change")
    key = (F.floor(h / 100) % KEYS).cast("bigint")
    bad = labels.where("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("pos")).distinct().withColumn("_toxic", F.lit(True))
    thin = docs.where("doc_id IS NOT NULL").select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stream"), F.col("doc_id").cast("bigint").alias("pos"), meaning.alias("op"), key.alias("key"),
        F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary")).alias("value"),
    )
    joined = thin.join(bad.hint("merge"), "pos", "left")
    live = F.col("value").isNotNull() & F.col("_toxic").isNull()
    return joined.select("stream", "pos", "op", "key", live.alias("live"), F.when(live, F.col("value")).alias("value"))


def digest(docs: DataFrame, labels: DataFrame, shift: int = SHIFT) -> DataFrame:
    """(kind, id, n, value): a `state` row for each epoch, an `abort` or `rollback` row for each undone change."""
    log = cut(records(docs, labels), "txlog-records")
    levels = levels_of(log, shift)
    changes = outcomes(log, levels, shift)
    undone = changes.where("outcome <> 'commit'").select(F.col("outcome").alias("kind"), F.col("pos").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return states(log, changes, EPOCH, levels, shift).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("n_keys").alias("n"), F.col("total").alias("value")).unionByName(undone)
