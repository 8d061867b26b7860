"""Transaction logs against a replay with a stack."""

import random
import zlib

import pytest

from foliospark.llm import queries, txlog

SCHEMA = "stream string, pos long, op string, key long, live boolean, value long"


def key_of(row):
    return tuple((x is None, x) for x in row)


def replay(log, every=16):
    """log: (stream, pos, op, key, value or None, back) in order -> (undone and committed changes, states)."""
    opened, store, changes, states, commits = {}, {}, [], [], 0
    for stream, pos, op, key, value, back in log:
        stack = opened.setdefault(stream, [])
        if op == "change":
            stack.append((pos, key, value))
        elif op == "savepoint":
            stack.append("savepoint")
        elif op == "rollback":
            back = back or 0
            while stack and (stack[-1] != "savepoint" or back):
                top = stack.pop()
                if top == "savepoint":
                    back -= 1
                else:
                    changes.append((stream, top[0], top[1], "rollback", pos))
        else:
            for e in stack:
                if e != "savepoint":
                    changes.append((stream, e[0], e[1], op, pos))
                    if op == "commit":
                        store.pop(e[1], None)
                        if e[2] is not None:
                            store[e[1]] = e[2]
            opened[stream] = []
            if op == "commit":
                commits += 1
                if commits % every == 0:
                    states.append((commits // every, len(store), sum(store.values())))
    for stream, stack in opened.items():
        changes += [(stream, e[0], e[1], "abort", None) for e in stack if e != "savepoint"]
    if commits % every:
        states.append((commits // every + 1, len(store), sum(store.values())))
    return changes, states


def check(spark, log, shift, every=16, with_back=True):
    schema = SCHEMA + (", back int" if with_back else "")
    rows = [(s, p, o, k, None if k is None else v is not None, v, *([b] if with_back else [])) for s, p, o, k, v, b in log]
    frame = spark.createDataFrame(random.sample(rows, len(rows)), schema)
    changes = txlog.outcomes(frame, shift=shift)
    want, states = replay(log, every)
    assert sorted(((r.stream, r.pos, r.key, r.outcome, r.by) for r in changes.collect()), key=key_of) == sorted(want, key=key_of)
    assert sorted(map(tuple, txlog.states(frame, changes, every, shift=shift).collect())) == states


def some_log(n, seed, streams=("a", "b"), ends=0.03, deep=False):
    rng, out = random.Random(seed), []
    for pos in sorted(rng.sample(range(3 * n), n)):
        x = rng.random()
        op = "commit" if x < ends else "abort" if x < 1.3 * ends else "savepoint" if x < 0.35 else "rollback" if x < 0.5 else "change"
        key, value = (rng.randrange(12), rng.choice([None, 1, 2, 3])) if op == "change" else (None, None)
        out.append((rng.choice(streams), pos, op, key, value, rng.choice([0, 0, 1, 2, 5, None]) if deep and op == "rollback" else None))
    return out


@pytest.mark.parametrize(("shift", "seed", "ends"), [(3, 2, 0.004), (10, 3, 0.05)])
def test_random_logs(spark, shift, seed, ends):
    check(spark, some_log(300, seed, ends=ends, deep=True), shift, every=3)


def test_one_huge_transaction_over_many_blocks(spark):
    """Savepoints first, one change at each height, then rollbacks that go down one height after the other: each change's rollback is many blocks on."""
    n = 60
    log = [x for i in range(n) for x in (("a", 2 * i, "savepoint", None, None, None), ("a", 2 * i + 1, "change", i % 7, i, None))]
    log += [("a", 2 * n + 5 * i, "rollback", None, None, 1) for i in range(n - 10)] + [("a", 9 * n, "commit", None, None, None)]
    check(spark, log, 3)


def test_without_back_the_savepoint_stays(spark):
    log = [("a", i, op, 1 if op == "change" else None, i if op == "change" else None, None) for i, op in enumerate("change savepoint change rollback change rollback rollback savepoint change savepoint rollback commit change".split())]
    check(spark, log, 3, with_back=False)
    changes, _ = replay(log)
    assert [c[3] for c in sorted(changes)] == ["commit", "rollback", "rollback", "commit", "abort"]


def log_of(docs, toxic):
    out = []
    for d, t, s in sorted((r for r in docs if r[0] is not None), key=lambda r: r[0]):
        h = zlib.crc32(str(d).encode())
        m, k = h % 41, h // 100 % 3000
        op = "commit" if m <= 1 else "abort" if m == 2 else "savepoint" if m <= 4 else "rollback" if m <= 6 else "change"
        out.append((s, d, op, k, None if t is None or d in toxic else zlib.crc32(f"{k}:{t}".encode()), None))
    return out


def wanted(docs, toxic):
    changes, states = replay(log_of(docs, toxic))
    return sorted([("state", *s) for s in states] + [(o, p, by, k) for _, p, k, o, by in changes if o != "commit"], key=key_of)


@pytest.mark.parametrize(("sf", "shift"), [("sf0.001", 10), ("sf0.01", 5)])
def test_query(spark, sf, shift):
    data = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    got = queries.op12_transactions(spark, data) if shift == 10 else txlog.digest(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"), shift)
    assert got.columns == ["kind", "id", "n", "value"]
    assert sorted(map(tuple, got.collect()), key=key_of) == wanted(docs, toxic)


def test_odd_rows(spark):
    """Null ids, texts, sources and labels, an empty source beside the null one, repeated labels, negative ids, a long text, clashing columns, empty tables."""
    rng = random.Random(5)
    docs = [(d, rng.choice([None, "", "é x", "y" * 50_000]), rng.choice([None, "", "s"])) for d in range(-40, 260)] + [(None, "t", "s"), (None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, pos int, op string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, None), (None, 1), (5, 0), (9, 1), (9, 0)], "doc_id long, toxic int")
    for shift in (4, 10):
        assert sorted(map(tuple, txlog.digest(frame, labels, shift).collect()), key=key_of) == wanted(docs, {3, 9})
    assert txlog.digest(frame.where("pos = 0"), labels).collect() == []
    # A change twice at one position is two records.
    again = txlog.digest(frame.where("doc_id IN (0, 1, 2, 3)").unionAll(frame.where("doc_id = 1")), labels).collect()
    assert len(again) == sum(1 for r in log_of(docs, set()) if r[1] in (0, 1, 2, 3) and r[2] == "change") + 1
