"""Repaired conversations against relaxation until nothing changes."""

import hashlib
import random
import re
import zlib

import pytest

from foliospark.llm import conversations, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    """(conv_id, turn, role, text) as the query's hash leaves them."""
    out = []
    plain = lambda x: " " if x is None else str(x)
    for c, t, r, x in rows:
        k = zlib.crc32(f"{plain(c)}:{plain(t)}".encode()) % 20
        r, x = plain(r), plain(x)
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    return out


def cheapest(rows, faults):
    """(cost, audit): from the last row on, each row's four states are relaxed over and over, (cost, letters) as a pair."""
    far, after = (10**9, ""), None
    for i in range(len(rows), -1, -1):
        here = [(0, "") if i == len(rows) and s in (0, 3) else far for s in range(4)]
        for _ in range(9):
            for s in range(4):
                ways = [here[s]] + [(here[to][0] + 3, "I" + here[to][1]) for q, to in NEXT[s].items() if q in NAMES]
                if i < len(rows):
                    more = 3 * (faults[i] == "truncated")
                    ways.append((after[s][0] + 4, "D" + after[s][1]))
                    for q, to in NEXT[s].items() if faults[i] in ("", "truncated") else ():
                        ways += [(after[to][0] + more, "K" + after[to][1])] * (rows[i][1][:1] == q)
                        ways += [(after[to][0] + 3 + more, "R" + after[to][1])] * (q in NAMES)
                here[s] = min(ways)
        after = here
    return after[0]


def brute(rows):
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in damage(rows):
        convs[c].append((t, r, x))
    out = []
    for c, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in held:
            w = x.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not w else "duplicate" if (r, x) in seen else "truncated" if w[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        cost, audit = cheapest(held, faults)
        state, i, said = 0, 0, []
        for e in audit:
            if e != "D":
                q = held[i][1][:1] if e == "K" else next(q for q in NEXT[state] if q in NAMES)
                said.append((held[i][1] if e == "K" else NAMES[q]) + ":" + ("" if e == "I" else held[i][2]))
                state = NEXT[state][q]
            i += e != "I"
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=key_of)


def key_of(row):
    return tuple((x is None, x) for x in row)


def check(frame, *turns):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    for t in turns:
        assert sorted(map(tuple, conversations.digest(frame, t).collect()), key=key_of) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversations(spark, f"/root/testdata/{sf}")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=key_of) == brute(rows)


def test_odd_rows(spark):
    """Nulls everywhere, repeated turns and rows, unknown and empty roles, clashing columns."""
    rng = random.Random(3)
    roles, texts = ["user", "user", "assistant", "assistant", "system", None, "", "tool", "umpire"], ["Yes.", "No!", "Why", "  ", None, "a b c.", "", "é?", "x" * 60_000 + "."]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts), 1, "x") for _ in range(300)]
    check(spark.createDataFrame(rows, SCHEMA + ", block int, digest string"), 10, 1, 3)


def test_one_long_conversation_in_blocks(spark):
    rng = random.Random(4)
    rows = [(5, i, rng.choice(["user", "assistant", "system"]), f"t {rng.randrange(700)}" + rng.choice([".", "", "!"])) for i in range(1500)]
    check(spark.createDataFrame(rows, SCHEMA), 10, 4)


def test_empty_table_and_dropped_rows(spark):
    assert conversations.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.digest(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_distances_are_those_of_the_cheapest_edits():
    rng = random.Random(6)
    for _ in range(200):
        rows = [(0, rng.choice("suax"), "") for _ in range(rng.randrange(8))]
        faults = [rng.choice(["", "", "blank", "duplicate", "truncated"]) for _ in rows]
        codes = "".join(conversations.code(r[1], f) for r, f in zip(rows, faults, strict=True))
        end = conversations.closing()
        got = conversations.distances(codes, end)
        assert (got[0], conversations.walk(codes, end, got, 0, True)[0]) == cheapest(rows, faults)
