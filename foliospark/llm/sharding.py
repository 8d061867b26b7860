"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's hash seeds a linear congruential generator whose numbers say at which shard counts the key jumps to the newest shard. The shard
is where the last jump below the shard count leads, so nothing but the key and the count is needed: no ring table, and one more shard
takes only the keys whose next jump is that shard. Rows are not shuffled to find their shard.

Nulls, ties and odd rows: a null key is one key of its own; a null text has no bytes and the CRC of the empty string; rows that are
equal in key, size and CRC lie in one shard and take slots of their own, next to each other; an empty table gives no rows. Equal texts
with different keys have nothing in common under this law. Other columns of the caller are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import let

#: The generator's multiplier and increment.
MULTIPLIER, INCREMENT = 2862933555777941757, 1
#: Shards of the query.
SHARDS = 16
#: Steps taken in the short fold; the few keys with more jumps than these go through a fold over all shards.
STEPS = 24
#: Blocks of a shard, by leading bits of a row's hash, and blocks of these, for numbering the rows.
BLOCK_BITS, PARENT_BITS = 20, 10
#: Equal rows that are made from their count at a time.
RUN = 65_536

_LOW = 0xFFFFFFFF


def _products(hi: Column, lo: Column) -> Column:
    """struct<hi, lo>: the halves of hi:lo * MULTIPLIER + INCREMENT modulo 2^64, by products that stay below 2^49, as ANSI mode lets none overflow."""
    mh1, mh0, ml1, ml0 = ((MULTIPLIER >> s) & 0xFFFF for s in (48, 32, 16, 0))
    upper = lambda p: F.shiftleft(p.bitwiseAND(F.lit(0xFFFF)), 16)

    def halves(p):
        s = lo * F.lit(ml1) + F.shiftright(p, 16)
        crossed = hi * F.lit(ml0) + upper(hi * F.lit(ml1)) + lo * F.lit(mh0) + upper(lo * F.lit(mh1))
        return F.struct((F.shiftright(s, 16) + crossed).bitwiseAND(F.lit(_LOW)).alias("hi"), upper(s).bitwiseOR(p.bitwiseAND(F.lit(0xFFFF))).alias("lo"))

    return let(lo * F.lit(ml0) + F.lit(INCREMENT), halves)


def jumps(h: Column, n: int) -> Column:
    """struct<b, j>: for a 64-bit hash h the last jump b below n, which is its shard among n, and the next jump j, at which count less one it moves again."""

    def step(acc, _):
        moved = lambda k: F.struct(acc["j"].alias("b"), F.floor((acc["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(k["hi"], 1) + 1))).alias("j"), k["hi"].alias("hi"), k["lo"].alias("lo"))
        return F.when(acc["j"] >= n, acc).otherwise(let(_products(acc["hi"], acc["lo"]), moved))

    def fold(start, steps):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    zero = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"), F.shiftrightunsigned(h, 32).alias("hi"), h.bitwiseAND(F.lit(_LOW)).alias("lo"))
    short = fold(zero, min(n, STEPS))
    done = let(short, lambda s: F.when(s["j"] >= n, s).otherwise(fold(s, n))) if n > STEPS else short
    return let(done, lambda s: F.struct(s["b"].alias("b"), s["j"].alias("j")))


def shard(key: Column, n: int) -> Column:
    """The shard, 0 to n - 1, of a key of any type that hashes."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    return jumps(F.xxhash64(key), n)["b"].cast("int")


def assigned(docs: DataFrame, n: int = SHARDS, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, shard, grown_shard, _kept_<column> ...): each row's shard among n and among n + 1. Nothing is shuffled."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    kept = [F.col(c).alias(f"_kept_{c}") for c in keep]
    got = docs.select(F.col(key).alias("_key"), *kept).withColumn("_at", jumps(F.xxhash64("_key"), n))
    own = F.coalesce(F.col("_at.b").cast("int"), F.lit(-1))  # never null, so that no filter computes it again
    return got.select(F.col("_key").alias(key), own.alias("shard"), F.when(F.col("_at.j") == n, n).otherwise(own).alias("grown_shard"), *[f"_kept_{c}" for c in keep])


def numbered(rows: DataFrame, shard_col: str, by: list[str]) -> DataFrame:
    """rows with `slot`: a number from 0 without gaps in each shard, in the order of a hash of the columns `by`, which are all that tells rows apart.

    Equal rows are counted first. Blocks of a shard, by leading bits of the hash, are numbered on their own and moved by what precedes them,
    first within their parent block, then within the shard; so no task holds a shard, and the largest group that isn't a block's
    rows has 2^PARENT_BITS of them.
    """
    keys = [shard_col, *by]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_h", F.xxhash64(*by))
    counted = counted.withColumn("_b", F.shiftrightunsigned("_h", 64 - BLOCK_BITS)).withColumn("_p", F.shiftrightunsigned("_h", 64 - PARENT_BITS))

    def before(df, group, order):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))

    blocks = counted.groupBy(shard_col, "_p", "_b").agg(F.sum("_n").alias("_n"))
    parents = before(blocks.groupBy(shard_col, "_p").agg(F.sum("_n").alias("_n")), [shard_col], ["_p"]).select(shard_col, "_p", F.col("_before").alias("_above"))
    starts = before(blocks, [shard_col, "_p"], ["_b"]).join(parents, [shard_col, "_p"]).select(shard_col, "_b", (F.col("_before") + F.col("_above")).alias("_start"))
    own = before(counted, [shard_col, "_b"], ["_h", *by]).join(starts, [shard_col, "_b"])
    runs = own.select(*keys, (F.col("_before") + F.col("_start")).alias("_first"), "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    at = F.col("_run") * RUN
    return runs.select(*keys, F.explode(F.sequence(F.col("_first") + at, F.col("_first") + F.least(F.col("_n"), at + RUN) - 1)).alias("slot"))


def facts(docs: DataFrame, n: int = SHARDS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard): all that is shuffled of a row for its slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(key).alias("_k"), (F.octet_length(text).cast("bigint") + 1).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))
    got = assigned(thin, n, "_k", keep=("_size", "_crc"))
    return got.select(F.col("_k").alias(key), F.col("_kept__size").alias("size"), F.col("_kept__crc").alias("text_crc32"), "shard", "grown_shard")


def digest(docs: DataFrame, n: int = SHARDS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = numbered(facts(docs, n, key, text_col), "shard", [key, "size", "text_crc32", "grown_shard"])
    return rows.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(docs: DataFrame, folder: str, n: int = SHARDS, key: str = "doc_id", files: int = 8) -> None:
    """Parquet under folder/shard=<i>/, about `files` files a shard: rows are dealt by shard and a hash of the key, so a shard is no task's work."""
    if clash := {"shard", "_part"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are in the way")
    dealt = docs.withColumn("shard", shard(F.col(key), n)).withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(files)))
    dealt.repartition(n * files, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(folder)


def moved(docs: DataFrame, n: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """(shard, rows, moves): how many rows each shard has and how many of them one more shard would take."""
    return assigned(docs, n, key).groupBy("shard").agg(F.count("*").alias("rows"), F.count_if(F.col("grown_shard") == n).alias("moves"))
