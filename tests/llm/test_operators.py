"""Each training-data operator against a brute-force version, with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, common, language, media, packing, quality, secrets, simhash, substring, topk, toxicity

SCHEMA = "doc_id long, text string, source string, score double, w string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 0.0, "x", 1) for d, t, s in rows], SCHEMA)


def some_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["émile", "Über", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 140))) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5] + " " + texts[6], "", None, "  \n ", texts[7] + " tail " + texts[8]]
    return [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(None, texts[3], None), (4, texts[3], "s0"), (4, texts[4], "s0")]


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "s") for i, t in enumerate(["", None, "a" * 3000, "Hello  world\n\n x", "é日本🙂" * 50, "ab " * 500, "<|endoftext|>"])]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows), path, P.PATTERN, keep_ids=True).collect()}
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def brute_removed(rows):
    words = [(d, (t or "").encode().split()) for d, t, _ in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 49):
                k = b" ".join(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[b" ".join(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rows = some_texts()
    got = sorted(map(tuple, substring.digest(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute_removed(rows), key=str)
    assert any(r[2] for r in got)
    assert substring.digest(frame(spark, rows[:1]).limit(0)).collect() == []


def test_substring_dedup_over_many_shards_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 60)
    monkeypatch.setattr(substring, "HOLDERS", 2)
    rng = np.random.default_rng(11)
    passages = [[f"p{i}w{x}" for x in rng.integers(0, 30, 50 + i)] for i in range(12)] + [["a", "b"] * 60, ["z"] * 130]
    rows = [(1, " ".join(passages[0]), None), (1, " ".join(passages[1]), None), (None, " ".join(passages[2]), None), (-3, None, None)]
    for d in range(2, 60):
        words: list[str] = []
        for i in rng.choice(len(passages), 3, p=np.r_[0.5, np.full(13, 0.5 / 13)]):
            p = passages[i]
            at = int(rng.integers(0, 8))
            words += p[at : len(p) - int(rng.integers(0, 3))] + [f"own{d}"] * int(rng.integers(0, 2))
        rows.append((d, " ".join(words), None))
    got = sorted(map(tuple, substring.digest(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute_removed(rows), key=str)
    assert len({r[2] for r in got}) > 20


def test_automaton_states_know_the_first_document():
    rng = np.random.default_rng(3)
    refs = [(int(d), [b"xy"[i : i + 1] for i in rng.integers(0, 2, 40)]) for d in rng.permutation(12)]
    automaton = substring.Automaton(6)
    for d, words in refs:
        automaton.add(d, words)
    automaton.close()
    for d in (-1, 0, 3, 7, 12):
        text = [b"xyz"[i : i + 1] for i in rng.choice(3, 300, p=[0.49, 0.49, 0.02])]
        held = [i for i in range(295) if any(r < d and any(w[j : j + 6] == text[i : i + 6] for j in range(35)) for r, w in refs)]
        assert automaton.starts(text, d).tolist() == held


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    path = list(range(-40, 40))
    mixed = rng.permutation(np.arange(100, 160)).tolist()
    pairs = list(zip(path, path[1:], strict=False)) + list(zip(mixed[1:], mixed, strict=False)) + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (150, 2)) if a != b]
    label = {x: x for pair in pairs for x in pair}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[::3]], "a bigint, b bigint")
    assert dict(map(tuple, simhash.components(rows).collect())) == label
    assert simhash.components(rows.limit(0)).collect() == []


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in v] for v in rng.normal(0, 0.2, (150, 12))]
    vecs[7] = vecs[8] = vecs[9] = vecs[10]
    rows = [*enumerate(vecs), (200, None), (201, [1.0, None]), (202, [float("nan")] * 12), (203, [float("inf")] * 12), (None, vecs[0]), (40, vecs[40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, lane=50, cells=48).collect()))
    held = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in [*enumerate(vecs), (40, vecs[40])]]
    want = []
    for a, (i, x) in enumerate(held):
        if i % 20 == 0:
            near = sorted((-int(x @ y), j) for b, (j, y) in enumerate(held) if b != a)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    assert got == sorted(want)


def test_top_k_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, v string, norm string, uid string, block string"
    empty = spark.createDataFrame([], schema)
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).collect() == []
    none = spark.createDataFrame([(1, [1.0], "x", "x", "x", "x")], schema)
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).collect() == []
    # Sums beyond a double's and a long's range, short and empty vectors, fewer candidates than k.
    vecs = [(0, [1e30, 1.0]), (1, [-1e30, 0.5]), (2, [2.0**50, 3.0]), (3, [1.0]), (4, []), (5, [1.0e305, 0.0]), (6, [0.25, -1e15]), (7, [2.0**24, 2.0**24 + 1 / 64])]
    rows = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in vecs], schema)
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in vecs]
    want = set()
    for i, x in held:
        near = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=False)))), j) for j, y in held if j != i)[:5]
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(near)}
    assert set(map(tuple, topk.top_k(rows, F.col("vec_id") >= 0, k=5).collect())) == want


def test_top_k_scores_few_pairs():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (6000, 64)) * np.linspace(2, 0.5, 64)
    v = np.floor(64 * v / np.sqrt((v**2).sum(1))[:, None])
    ids = np.arange(len(v))
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    block = topk.Block(ids[::20], v[::20], turn, 20)
    block.meet(ids, ids, v)
    row, near, score = block.found()
    want = v[::20] @ v.T
    want[np.arange(len(want)), ids[::20]] = -np.inf
    assert (np.sort(score.reshape(-1, 20)) == np.sort(-np.partition(-want, 19, axis=1)[:, :20])).all()
    assert block.pairs == 300 * 6000 and block.scored < 0.05 * block.pairs


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_spans(t):
    t = t or ""
    got = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    got += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    got += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    kinds = ["assign", "access", "hex"]
    return sorted(got, key=lambda x: (x[1], kinds.index(x[0])))


def test_secret_scan_equals_brute_force(spark):
    rng = random.Random(2)
    parts = ["token", "secret", "API_KEY", "apikey", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "zz", "🙂", "=="]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))), "s") for i in range(250)] + [(None, "token=abcdefghijklmnop", "s"), (300, None, "s"), (300, "secret: 123456789012345", "s")]
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(frame(spark, rows)).collect())
    want = []
    for d, t, _ in rows:
        s = brute_spans(t)
        n = [sum(x[0] == k for x in s) for k in ("assign", "access", "hex")]
        want.append((str(d), *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert got == sorted(want) and any(r[1] for r in got)


def test_trigram_queries(spark):
    assert secrets.query("[0-9a-f]{16,}") == ()
    assert secrets.query("AKIA[A-Z0-9]+") == (frozenset({frozenset({"aki", "kia"})}),)
    assert any(frozenset({"api", "pik", "ike", "key"}) in clause for clause in secrets.query(secrets.BASE[0].regex))


def test_redaction(spark):
    df = frame(spark, [(1, "a token=abcdefabcdefabcdef9 b", "s"), (2, "clean", "s"), (3, None, "s")])
    found = secrets.scan(df)
    got = {r.doc_id: r.t for r in found.select("doc_id", secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()}
    assert got == {1: "a [REDACTED] b", 2: "clean", 3: None}


def brute_components(rows, size, radius):
    fps = [simhash.fingerprint(simhash.shingle_hashes(t, size)) for _, t, _ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for (d, *_), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return sorted((str(d), f"{f:016x}", str(least.get(x))) for (d, *_), f, x in zip(rows, fps, label, strict=True))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(8)
    rows = some_texts()
    base = [f"v{rng.randrange(90)}" for _ in range(400)]
    for i in range(25):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
        rows.append((500 + i, " ".join(w), "s"))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows, 3, 3)


def test_keep_one_drops_near_copies_and_keeps_others(spark):
    rng = random.Random(4)
    docs = [[f"x{rng.randrange(5000)}" for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(docs)]
    rows += [(100 + i, " ".join([*w[:-1], "changed"]), "s") for i, w in enumerate(docs)] + [(200, rows[0][1], "s"), (300, None, "s"), (None, "y", "s")]
    got = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert {i for i in range(20)} | {300, None} <= got and 200 not in got
    assert len([i for i in got if i is not None and 100 <= i < 120]) <= 2


def check_bins(got, capacity, per_source, rows):
    by = {}
    for r in got:
        if r.bin_id:
            by.setdefault(r.bin_id, []).append(r)
    text = {}
    for d, t, s in rows:
        text.setdefault(d, []).append((t, s))
    for bin_rows in by.values():
        assert sum(r.n_units for r in bin_rows) <= capacity
        at = 0
        for r in sorted(bin_rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_units


def brute_pack(items, capacity, per_source):
    bins = []
    for n, s, c in items:
        fit = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= n and sum(x[1] == s for x in b) < per_source and all(x[2] != c or c < 0 for x in b)]
        if fit:
            bins[min(fit)[1]].append((n, s, c))
        else:
            bins.append([(n, s, c)])
    return bins


def test_packing_is_best_fit_under_conflicts(spark):
    rng = random.Random(6)
    items = sorted(((rng.randrange(1, 60), rng.randrange(3), rng.randrange(-1, 12)) for _ in range(200)), key=lambda x: -x[0])
    bins, offsets = packing.pack(*map(list, zip(*items, strict=True)), 100, 2)
    got = {}
    for b, x in zip(bins, items, strict=True):
        got.setdefault(b, []).append(x)
    assert [got[b] for b in sorted(got)] == brute_pack(items, 100, 2)
    rows = some_texts() + [(900, "word " * 950, "s1")]
    out = packing.pack_documents(frame(spark, rows), capacity=100, shard_rows=20).collect()
    assert sum(r.n_units for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    check_bins(out, 100, 2, rows)
    assert packing.pack_documents(frame(spark, rows).limit(0)).collect() == []


def test_media_round_trip(spark):
    rows = some_texts()
    got = media.media_columns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), len((t or "").encode())) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == want
    for r in got:
        assert r.payload_bytes % 192 == 0 and r.payload_bytes > 0
    payload, n = media.decode(media.encode("héllo"))
    assert payload == "héllo".encode().ljust(192) and n == 6
    by = {r.doc_id: r for r in got}
    t = dict((d, t) for d, t, _ in rows)[0] or ""
    raw = t.encode()
    raw = raw.ljust(max(192, -(-len(raw) // 192) * 192))
    assert by[0].payload_sha256 == hashlib.sha256(raw).hexdigest() and by[0].tail_crc32 == zlib.crc32(raw[-16:])


def test_media_ranges_and_retries(spark, tmp_path):
    folder, manifest = media.write_archives(frame(spark, some_texts()))
    small = media.read_archives(spark, folder, manifest, range_bytes=700, batch_bytes=300)
    assert small.count() == len(some_texts()) and small.select("member", "offset", "doc_id").distinct().count() == len(some_texts())

    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("00000000_1.png", b"body")
    tries = []

    class Flaky(io.BytesIO):
        def read(self, *a):
            if len(tries) < 2:
                tries.append(1)
                raise OSError("gone")
            return super().read(*a)

    info = zipfile.ZipFile(held).infolist()[0]
    assert media.read_member(lambda: Flaky(held.getvalue()), info, wait=0) == b"body"
    with pytest.raises(OSError):
        media.read_member(lambda: io.BytesIO(b"x" * 60), info, tries=2, wait=0)


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(9)
    plain = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(8)) + "."
    texts, labels = [], []
    for i in range(400):
        s = [plain() for _ in range(rng.randrange(1, 8))]
        if i % 4 == 0:
            s[rng.randrange(len(s))] = f"you {rng.choice(['moron', 'scum', 'idiot'])} there."
        texts.append(" ".join(s))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels)
    rows = [(1, "w1 w2. you scum there. w3 w4.", "s"), (2, "w1 w2 w3. w5.", "s"), (3, "", "s"), (4, None, "s"), (5, "...", "s")]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    assert got[1].predicted == 1 and got[1].worst_sentence == 1 and got[2].predicted == 0
    assert got[3].score == got[4].score == got[5].score == 0 and got[3].worst_sentence is None
    assert toxicity.train([], []).bias < 0 and toxicity.train(["a"], [1]).bias < 0


def test_quality_learns(spark):
    rng = random.Random(10)
    good = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(150)]
    bad = [" ".join(f"w{rng.randrange(300)}###" for _ in range(40)) for _ in range(80)]
    model = quality.train(good + bad, [1] * 150 + [0] * 80)
    got = {r.doc_id: r for r in quality.score(frame(spark, [(1, "w1 w2 w3 w900 w901", "s"), (2, "w1### w77### w950###", "s"), (3, None, "s"), (4, "", "s")]), model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == got[4].score and 0 <= got[3].score <= 1


def test_language_learns(spark):
    en, de = ["the cat and the dog are here with that"] * 5, ["der hund und die katze sind nicht mit dem"] * 5
    model = language.train(en + de, ["en"] * 5 + ["de"] * 5)
    rows = [(1, "the house with that", "s"), (2, "und der die nicht", "s"), (3, None, "s"), (4, "123 !!", "s")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.score(frame(spark, rows), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", 0.0)
    assert language.score(frame(spark, rows), language.train([], [])).first().lang_pred == "und"


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = [sorted(r.k for r in common.bounded_sample(df.repartition(n), "k", 100).collect()) for n in (3, 7)]
    assert a == b and len(a) == 100
