"""The quality score against a softmax over mean vectors, and how many bins sharded packing needs."""

import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import packing, quality

WORDS = ["good", "fine", "prose", "bad", "spam", "buy", "now", "émile", "日本"]


def features(text, buckets):
    """Buckets of the words, of their marked 3- and 4-grams and of neighbouring words, one by one."""
    words, out = (text or "").split(), []
    for w in words:
        b = f"<{w}>"
        out += [zlib.crc32(b"w" + w.encode()) % buckets] + [zlib.crc32(b[i : i + n].encode()) % buckets for n in (3, 4) for i in range(len(b) - n + 1)]
    for a, b in zip(words, words[1:], strict=False):
        h = [zlib.crc32(x.encode(), 77) for x in (a, b)]
        out.append(0 if a == b else ((((h[0] * quality.MIX + h[1]) % 2**64) * quality.MIX % 2**64) >> 20) % buckets)
    return out


def test_the_score_is_a_softmax_over_the_mean_vector(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS[:3] if i % 2 else WORDS[3:], 1 + i % 9)) for i in range(80)]
    made, held = quality.Model, {}

    def caught(values, bias):
        held.update({k: sys._getframe(1).f_locals[k] for k in ("e", "out", "bias")})
        return made(values, bias)

    monkeypatch.setattr(quality, "Model", caught)
    model = quality.train(texts, [i % 2 for i in range(80)], buckets=1 << 12, least_steps=60)
    monkeypatch.undo()
    asked = [*texts[:20], None, "", "  ", "good", "good good", "unseen words here", "spam " * 3000]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(asked):
        f = features(text, 1 << 12)
        mean = held["e"][f].astype(np.float64).mean(0) if f else np.zeros(held["e"].shape[1])
        z = mean @ held["out"].astype(np.float64) + held["bias"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].score == pytest.approx(p[1], abs=1e-5) and got[i].predicted == int(got[i].score >= 0.5)


def test_shards_cost_few_bins(spark):
    """10,000 documents in shards of 1024 rows need at most 2 % more bins than best fit over all of them, which is within 10 % of the least that space allows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    units = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    slim = docs.select("doc_id", "source", units.alias("n"), F.xxhash64("text").alias("cluster")).persist()

    def used(rows):
        got = packing.best_fit(slim, F.col("n"), F.col("cluster"), shard_rows=rows)
        return got.where("bin_id IS NOT NULL").agg(F.countDistinct("bin_id")).first()[0]

    least = -(-slim.agg(F.sum("n")).first()[0] // packing.CAPACITY)
    whole, sharded = used(1 << 40), used(1024)
    print("bins:", least, whole, sharded)
    assert whole <= sharded <= 1.02 * whole and whole <= 1.1 * least
