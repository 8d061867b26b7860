"""The queries of the training-data operators on whole small tables, recomputed from their contracts, and odd tables for every operator."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, language, media, packing, quality, queries, secrets, simhash, substring, topk, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def crc(d, mod):
    return zlib.crc32(str(d).encode()) % mod


def test_packing_keeps_to_both_conflicts(spark, docs):
    text, source = {d: t for d, t, *_ in docs}, {d: s for d, *_, s in docs}
    got = queries.op1_packing(spark, DATA).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in (b for k, b in bins.items() if k):
        held = sorted(rows, key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in held] == list(np.cumsum([0, *[r.n_units for r in held[:-1]]])) and sum(r.n_units for r in held) <= packing.CAPACITY
        sources = [source[r.doc_id] for r in held]
        assert max(sources.count(s) for s in sources) <= packing.PER_SOURCE
        assert len({text[r.doc_id] for r in held}) == len(held)
    units = {}
    for r in got:
        units[r.doc_id] = units.get(r.doc_id, 0) + r.n_units
    assert units == {d: len((t or "").encode().split()) for d, t, *_ in docs}
    # These documents are one shard.
    assert len({r.bin_id.split("-")[0] for r in got if r.bin_id}) == 1


def check_scores(got, docs, mod, rest):
    assert sorted(r.doc_id for r in got) == [d for d, *_ in docs]
    for r in got:
        assert r.held_out == (crc(r.doc_id, mod) == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_toxicity_is_the_noisy_or_of_sentences(spark, docs):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, DATA).collect()}
    check_scores(got.values(), docs, 5, 0)
    model = queries.toxicity_model(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    some = [(d, t) for d, t, *_ in docs if t and d % 5 == 0]
    parts = [(d, i, s) for d, t in some for i, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+|\n", t) if x.strip())]
    frame = spark.createDataFrame([(k, s) for k, (_, _, s) in enumerate(parts)], "doc_id long, text string")
    by_part = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for d, _ in some:
        scores = [by_part[k] for k, p in enumerate(parts) if p[0] == d]
        assert got[d].score == pytest.approx(1 - np.prod(1 - np.array(scores)), abs=1e-6)


def test_quality_scores(spark, docs):
    got = queries.op4_quality(spark, DATA).collect()
    check_scores(got, docs, 3, 1)
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_language_is_the_posterior_of_naive_bayes(spark, docs):
    got = {r.doc_id: r for r in queries.op5_language(spark, DATA).collect()}
    learn = [(t, x) for d, t, x, _ in docs if crc(d, 3) != 1 and x is not None]
    grams = lambda t: [g for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for b in [f"<{w}>"] for n in language.NGRAMS for g in (zlib.crc32(b[i : i + n].encode()) % (1 << 16) for i in range(len(b) - n + 1))]
    counts, seen = {}, {}
    for t, x in learn:
        counts.setdefault(x, np.full(1 << 16, 0.5))
        np.add.at(counts[x], grams(t), 1)
        seen[x] = seen.get(x, 0) + 1
    logp = {x: np.log(c / c.sum()) for x, c in counts.items()}
    for d, t, *_ in docs:
        z = {x: np.log(seen[x] / len(learn)) + logp[x][grams(t)].sum() for x in sorted(logp)}
        best = max(z, key=z.get)
        assert got[d].held_out == (crc(d, 3) == 1)
        if grams(t):
            assert got[d].lang_pred == best and got[d].score == pytest.approx(1 / sum(np.exp(v - z[best]) for v in z.values()), abs=1e-9)
        else:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)


def test_signs_are_no_letters(spark):
    model = language.train(["the cat", "der hund"], ["en", "de"])
    rows = [(1, "² ½ Ⅷ"), (2, "٣_9"), (3, "½the")]
    got = {r.doc_id: r.lang_pred for r in language.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}


def all_spans(text, rules=secrets.BASE + secrets.ADDED):
    found = [(m.start(), k, r.kind, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.regex, text or "", re.A) if len(m[r.group]) >= r.least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_all_secret_spans(spark, docs):
    got = {r.doc_id: r for r in queries.op8_secrets(spark, DATA).collect()}
    assert {d: r.spans for d, r in got.items()} == {d: all_spans(t) for d, t, *_ in docs}
    for d, t, *_ in docs:
        base = all_spans(t, secrets.BASE)
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    planted = ["ghp_" + "a" * 36, "xoxb-" + "1" * 12, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10]
    many = " é ".join(["token=short", "password: 'abcdefghijkl'", "0123456789abcdef"] * 150)
    rows = [(i, t, "x", "y", 1) for i, t in enumerate([*planted, " ".join(planted), many, "", None])] + [(0, "token=abcdefghijkl", "x", "y", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, found string, _cand_id string, _rules int")
    found = secrets.scan(frame).withColumn("spans", secrets.written(F.col("found"))).collect()
    assert sorted((r.text or "", r.spans) for r in found) == sorted((t or "", all_spans(t)) for _, t, *_ in rows)


def test_each_rule_has_its_whole_query():
    assert secrets.query(r"eyJ[a-z]{10,}\.eyJ") == (frozenset({frozenset({"eyj"})}), frozenset({frozenset({".ey", "eyj"})}))
    assert secrets.query(r"[0-9a-f]{16,}") == ()


def test_all_media_columns(spark, docs):
    got = {r.doc_id: r for r in queries.op10_media(spark, DATA).collect()}
    assert sorted(got) == [d for d, *_ in docs]
    for d, t, *_ in docs:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = media.encode(t)
        x = np.frombuffer(payload, np.uint8).astype(float)
        mean, dev, step = (float(v.split("=")[1]) for v in got[d].feature.split(";")[:3])
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (got[d].media_bytes, got[d].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (mean, dev, step) == pytest.approx((x.mean(), x.std(), np.abs(np.diff(x)).mean()), abs=2e-3)


ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, a long, key string, found string, shard int, _of long, _gone long, h1 long, score double, id long, label long"


def odd(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 0, 1, 1, "k", "f", 1, 1, 1, 1, 0.5, 1, 1) for d, t in rows], ODD)


RUNS = {
    "packing": lambda df: packing.pack_documents(df),
    "bpe": lambda df: bpe.round_trip(df, *ranks()),
    "toxicity": lambda df: toxicity.score(df, toxicity.train([], [])),
    "quality": lambda df: quality.score(df, quality.train([], [])),
    "language": lambda df: language.score(df, language.train([], [])),
    "substring": lambda df: substring.digest(df),
    "secrets": lambda df: secrets.digest(df),
    "simhash": lambda df: simhash.near_duplicates(df),
    "keep_one": lambda df: simhash.keep_one(df),
    "media": lambda df: media.media_columns(df),
}


def ranks():
    import public_tokenizers as P

    return P.path(queries.RANKS), P.PATTERN


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_tables(spark, name):
    """Empty tables give no rows. Nulls, empty texts, repeated rows, one long text and columns of the operators' own names give a row each."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(60_000))
    rows = [(1, "one two three"), (1, "one two three"), (None, "x y z"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "é" * 3000), (7, "\u0000a b")]
    assert RUNS[name](odd(spark, [])).collect() == []
    got = RUNS[name](odd(spark, rows)).collect()
    ids = sorted({(r.doc_id is not None, r.doc_id or 0) for r in got})
    assert ids == [(False, 0), *[(True, d) for d in range(1, 8)]]
    assert name == "packing" or len(got) == len(rows)


def test_top_k_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    v = np.array([np.floor(64 * np.array(x)) for _, x in rows]).astype(int)
    ids = [i for i, _ in rows]
    want = set()
    for q in (k for k, i in enumerate(ids) if i % 20 == 0):
        near = sorted((-int(v[q] @ v[k]), i) for k, i in enumerate(ids) if k != q)[:20]
        want |= {(ids[q], n + 1, i, -s) for n, (s, i) in enumerate(near)}
    assert set(map(tuple, queries.op7_topk(spark, DATA).collect())) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []
