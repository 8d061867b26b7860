"""The stages one by one on the smallest test tables."""

import re

import corpus_pipeline as P
import pytest
from foliospark.llm import queries, secrets

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before = docs.count()
        out = P.cut(stage(spark, docs, DATA), name)
        assert out.columns == list(P.COLUMNS)
        assert 0 < out.count() <= before
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    packed = P.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.n_units <= 2048 for r in packed)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert P.STAGES[k][1](spark, docs, DATA).count() == 0


def near_copies_out(rows):
    """Of each group that pairs of a Jaccard similarity of 0.8 or more join, over five-word shingles, the row of the least doc_id; texts without words are alike if equal."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {("none", text)})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d for i, (d, _) in enumerate(rows) if least[root(i)] == d}


def passages_out(rows):
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d, w in sorted(words.items()):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    out = {}
    for d, t in rows:
        w = words[d]
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for p in range(i, i + 50)}
        out[d] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t
    return out


def secrets_out(text):
    spans = sorted((m.start(), m.end()) for r in secrets.BASE + secrets.ADDED for m in re.finditer(r.regex, text or "", re.A) if len(m[r.group]) >= r.least)
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def test_every_stage_equals_a_brute_force_version(spark):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs.select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()
        docs = P.cut(stage(spark, docs, DATA), f"test-{name}")
        seen[name] = (before, docs.collect())
    before, after = seen["toxicity"]
    calm = {r.doc_id for r in queries.op3_toxicity(spark, DATA).where("predicted = 0").collect()}
    assert sorted(after) == [r for r in before if r.doc_id in calm]
    before, after = seen["near_duplicates"]
    left = near_copies_out([(r.doc_id, r.text) for r in before])
    assert len(left) < len(before) and sorted(after) == [r for r in before if r.doc_id in left]
    before, after = seen["substrings"]
    want = passages_out([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == want and any(want[r.doc_id] != r.text for r in before)
    assert all(r.n_chars == len(r.text) for r in after if r.text != {b.doc_id: b.text for b in before}[r.doc_id])
    before, after = seen["secrets"]
    want = {r.doc_id: secrets_out(r.text) for r in before}
    assert {r.doc_id: r.text for r in after} == want and any("[REDACTED]" in t for t in want.values())
    before, after = seen["packing"]
    units = {r.doc_id: 0 for r in before}
    for r in after:
        units[r.doc_id] += r.n_units
    assert units == {r.doc_id: len((r.text or "").encode().split()) for r in before}
    assert sorted(map(str, P.run(spark, DATA).collect())) == sorted(map(str, after))
