"""Jump consistent hashing and the slots against a plain loop."""

import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import queries, sharding

DATA = "/root/testdata/sf0.001"


def jump(h, n):
    b, j = -1, 0
    while j < n:
        b = j
        h = (h * sharding.MULTIPLIER + sharding.INCREMENT) % 2**64
        j = int((b + 1) * (2**31 / ((h >> 33) + 1)))
    return b


def hashed(key):
    return 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)


def check(rows, got, n):
    """rows: (key, text); got: digest()'s rows."""
    want = Counter()
    for key, text in rows:
        raw = (text or "").encode()
        want[key, len(raw) + 1, zlib.crc32(raw), "key", jump(hashed(key), n), jump(hashed(key), n + 1)] += 1
    assert Counter((r[0], r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, n) for r in got)


@pytest.mark.parametrize("n", [1, 2, 16, 1000, 100_003])
def test_shards_equal_the_loop(spark, n):
    got = spark.range(-300, 1500).select("id", sharding.shard(F.col("id"), n).alias("s")).collect()
    assert {r.id: r.s for r in got} == {k: jump(hashed(k), n) for k in range(-300, 1500)}


def test_a_key_with_more_jumps_than_the_short_fold(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEPS", 2)
    got = spark.range(500).select("id", sharding.shard(F.col("id"), 200).alias("s")).collect()
    assert {r.id: r.s for r in got} == {k: jump(hashed(k), 200) for k in range(500)}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op11_sharding(spark, DATA).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect(), 16)


def test_odd_rows(spark, monkeypatch):
    """Null keys and texts, repeated rows (more of them than are made at a time), a long text, columns with clashing names, an empty table."""
    monkeypatch.setattr(sharding, "RUN", 4)
    rows = [(None, None), (None, None), (None, "x"), (1, ""), (1, "é" * 70_000), (2, None), *[(7, "again")] * 30, *[(k, "same") for k in range(100, 160)]]
    docs = spark.createDataFrame([(k, t, 5, 6, "c") for k, t in rows], "doc_id long, text string, shard int, slot int, _h string")
    got = sharding.digest(docs, 3).collect()
    check(rows, got, 3)
    assert sharding.digest(docs.where("slot = 0"), 3).collect() == []
    kept = sharding.assigned(docs, 3, keep=("shard", "text")).where("doc_id = 2").collect()
    assert [(r._kept_shard, r._kept_text) for r in kept] == [(5, None)] and kept[0].shard == jump(hashed(2), 3)
    moved = sharding.moved(docs, 3).collect()
    assert sum(r.moves for r in moved) == sum(jump(hashed(k), 4) == 3 for k, _ in rows) and sum(r["rows"] for r in moved) == len(rows)


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write(docs, str(tmp_path / "out"), 5, files=2)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.shard for r in back} == {k: jump(hashed(k), 5) for k in range(400)}
    with pytest.raises(ValueError, match="in the way"):
        sharding.write(docs.withColumn("shard", F.lit(1)), str(tmp_path / "again"), 5)


def test_no_python_runs(spark):
    plan = queries.op11_sharding(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
