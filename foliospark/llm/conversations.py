"""Repair of conversations whose structure is broken: the cheapest edits that make the roles read (system)? (user assistant)+, or nothing at all.

The edits are arcs of a layered graph: nodes are (rows read, state of the role pattern), arcs are the edits with small integer costs.
Distances to the end are found by Dial's bucket queue, backwards; the audit is the walk over tight arcs, those on a cheapest path, that
takes the ASCII-least letter at each node.

Each row is one of twelve codes (the role's initial and its fault), which is all that the graph needs, so texts are shuffled
once, at the end. A conversation is cut into blocks of TURNS turns. A block's distances from each of its four entry states to each exit
state are a small matrix; the matrices of a conversation, 16 numbers a block, are folded from the last block to the first; then every block
walks on its own, from each entry state, and the block that is really entered is chosen as the conversation is written. That last step
streams a conversation's rows in order through one task, because one SHA-256 over the whole conversation is asked for; it holds
a row at a time and the conversation's audit.

Nulls, ties and odd rows: a null role, text, key or turn counts as one space, but null turns come first and don't count for gaps; rows
of one turn are ordered by role and then by the SHA-256 of the text; a role that begins with another letter, or with none,
can't be kept; a conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table has no rows.
Other columns of the caller are not looked at. Rows of one turn, and rows without a turn, are one block's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Memo, slices

#: Turns of a block, as a power of two.
TURNS = 10
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Role initials, and the white space of a blank text.
ROLES, SPACE = "sua", "\x20\t\n\x0b\f\r"
#: The pattern's states: nothing yet, after the system row, after a user's, after an assistant's. For each the role that may come next and the state behind it.
STATES, FINAL = 4, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 40
#: Rows of a block that are few enough for its walks to be remembered, and how many blocks are.
SHORT, WALKS = 32, 50_000


def code(initial: str, fault: str) -> str:
    """One letter for a row: its role's initial (s, u, a or another) and its fault (none, blank, duplicate, truncated)."""
    return chr(ord("A") + "sua?".index(initial if initial and initial in ROLES else "?") * 4 + ("", "blank", "duplicate", "truncated").index(fault))


def _row_arcs() -> dict[str, list[list[tuple[str, int, int]]]]:
    """code -> for each state the (letter, cost, next state) of the edits that take the row."""
    out = {}
    for initial in "sua?":
        for fault in ("", "blank", "duplicate", "truncated"):
            more, arcs = TRUNCATED if fault == "truncated" else 0, []
            for state in range(STATES):
                own = [("D", DELETE, state)]
                if fault in ("", "truncated"):
                    if initial in NEXT[state]:
                        own.append(("K", more, NEXT[state][initial]))
                    own += [("R", REROLE + more, to) for role, to in NEXT[state].items() if role in NAMES]
                arcs.append(own)
            out[code(initial, fault)] = arcs
    return out


ARCS = _row_arcs()
#: For each state the (letter, cost, next state) of an insertion.
INSERTS = [[("I", INSERT, to) for role, to in NEXT[state].items() if role in NAMES] for state in range(STATES)]


def _backwards(arcs) -> list[list[tuple[int, int]]]:
    """For each state the (cost, state before) of the arcs that lead to it."""
    out = [[] for _ in range(STATES)]
    for state, own in enumerate(arcs):
        for _, cost, to in own:
            out[to].append((cost, state))
    return out


BACK = {c: _backwards(arcs) for c, arcs in ARCS.items()}
BACK_INSERTS = _backwards(INSERTS)


def distances(codes: str, end: tuple[int, ...]) -> list[int]:
    """The cost of the cheapest edits from each node to the end, at index rows read * STATES + state, where a state costs end[state] behind the last row. Dial's buckets."""
    n = len(codes)
    got = [FAR] * ((n + 1) * STATES)
    buckets: dict[int, list[int]] = {}
    for state, cost in enumerate(end):
        if cost < FAR:
            got[n * STATES + state] = cost
            buckets.setdefault(cost, []).append(n * STATES + state)
    at = min(buckets, default=0)
    while buckets:
        for node in (held := buckets.pop(at, [])):  # arcs without a cost add to the bucket that is open
            if got[node] != at:
                continue
            row, state = divmod(node, STATES)
            for cost, before in BACK_INSERTS[state]:
                if at + cost < got[to := row * STATES + before]:
                    got[to] = at + cost
                    buckets.setdefault(at + cost, []).append(to)
            if row:
                for cost, before in BACK[codes[row - 1]][state]:
                    if at + cost < got[to := (row - 1) * STATES + before]:
                        got[to] = at + cost
                        (held if not cost else buckets.setdefault(at + cost, [])).append(to)
        at += 1
    return got


def walk(codes: str, end: tuple[int, ...], got: list[int], state: int, last: bool) -> tuple[str, int]:
    """(audit, exit state) of the ASCII-least walk over tight arcs. Before another block it stops as soon as all rows are read, as inserting is left to that block."""
    row, out, n = 0, [], len(codes)
    while True:
        here = got[row * STATES + state]
        if row == n and (not last or (here == end[state] and state in FINAL)):
            return "".join(out), state
        arcs = [(letter, cost, to, row) for letter, cost, to in INSERTS[state]]
        if row < n:
            arcs += [(letter, cost, to, row + 1) for letter, cost, to in ARCS[codes[row]][state]]
        letter, _, state, row = min(a for a in arcs if here == a[1] + got[a[3] * STATES + a[2]])
        out.append(letter)


def matrix(codes: str) -> list[int]:
    """Costs from each entry state (rows) to each exit state of a block, flat."""
    by_exit = [distances(codes, tuple(0 if s == to else FAR for s in range(STATES)))[:STATES] for to in range(STATES)]
    return [by_exit[to][at] for at in range(STATES) for to in range(STATES)]


def closing() -> tuple[int, ...]:
    """What is left to pay behind the last row: insertions until the pattern may end."""
    return tuple(distances("", tuple(0 if s in FINAL else FAR for s in range(STATES))))


def damaged(chats: DataFrame) -> DataFrame:
    """The query's damage: (conv_id, turn, role, text, copies) where copies is 0 for a dropped row and 2 for a repeated one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    got = chats.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return got.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


ORDER = ["turn", "role", "digest"]


def block_of(turns: int) -> Column:
    """The block of a row's turn; rows without a turn are in the first."""
    return F.coalesce(F.shiftright("turn", turns), F.lit(-(1 << 62)))


def coded(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, block, codes) of rows (conv_id, turn, role, text, copies): a row's fault is blank, else duplicate, else truncated.

    The first of equal rows is found by an aggregate over hashes, so that a row that is said a million times is no task's group.
    """
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(said == "", "blank").when(F.right(said, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    thin = rows.where("copies > 0").select("conv_id", "turn", "role", "copies", F.sha2("text", 256).alias("digest"), fault.alias("fault"), block_of(turns).alias("block"))
    # Rows that are equal in all of this are counted; only the first of the smallest turn is no duplicate.
    equal = thin.groupBy("conv_id", "block", *ORDER, "fault").agg(F.sum("copies").alias("copies"))
    least = equal.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(F.struct("turn")).alias("_least"))
    seen = equal.join(least, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    seen = seen.withColumn("_first", F.col("turn").eqNullSafe(F.col("_least.turn")))
    letter = lambda f: F.coalesce(*[F.when((F.left("role", F.lit(1)) == i) & (F.col("fault") == f), code(i, f)) for i in ROLES], F.lit(code("?", f)))
    own = F.when(F.col("fault") == "blank", letter("blank")).when(F.col("fault") == "truncated", letter("truncated")).otherwise(letter(""))
    again = F.when(F.col("fault") == "blank", letter("blank")).otherwise(F.coalesce(*[F.when(F.left("role", F.lit(1)) == i, code(i, "duplicate")) for i in ROLES], F.lit(code("?", "duplicate"))))
    codes = F.concat(F.when(F.col("_first"), own).otherwise(again), F.repeat(again, (F.col("copies") - 1).cast("int")))
    held = seen.select("conv_id", "block", F.struct(*ORDER, codes.alias("codes")).alias("row"))
    return held.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["codes"]), "").alias("codes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in descending order within each conversation: adds what each exit state still costs behind the block, and whether it is the last one."""
    final = closing()
    conv, behind, later = object(), final, ""
    for b in slices(batches):
        ends, last = [], []
        for c, codes in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            last.append(c != conv)
            if c != conv:
                conv, behind = c, final
            else:
                m = matrix(later)
                behind = tuple(min(m[at * STATES + to] + behind[to] for to in range(STATES)) for at in range(STATES))
            later = codes
            ends.append(behind)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(e) for e in ends], pa.list_(pa.int64())), pa.array(last, pa.bool_())], [*b.schema.names, "ends", "last"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and entry state: the audit, the exit state and the cost from there to the conversation's end."""

    def walked(key):
        codes, end, last = key
        got = distances(codes, end)
        each = [walk(codes, end, got, s, last) for s in range(STATES)]
        return [a for a, _ in each], [x for _, x in each], got[:STATES]

    memo = Memo(walked)
    for b in slices(batches):
        got = [(memo.__getitem__ if len(codes) <= SHORT else walked)((codes, tuple(e), last)) for codes, e, last in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        if len(memo) > WALKS:
            memo.clear()
        columns = [pa.array([g[i] for g in got], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["conv_id", "block", "codes", "audits", "exits", "costs"])


def audits(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, block, codes, audits, exits, costs): the last three by the state in which the block is entered."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = coded(rows, turns)
    ended = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_ends, f"conv_id {kind}, block long, codes string, ends array<long>, last boolean")
    return ended.repartition("conv_id", "block").mapInArrow(_walks, f"conv_id {kind}, block long, codes string, audits array<string>, exits array<int>, costs array<long>")


class _Chat:
    """A conversation as its rows come by in order."""

    def __init__(self):
        self.audit, self.hash, self.written, self.state, self.cost = [], hashlib.sha256(), False, 0, None
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.role, self.edits, self.at = None, "", 0

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.written = True

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            role, self.state = next((r, to) for r, to in NEXT[self.state].items() if r in NAMES)
            self.say(NAMES[role], "")
            self.at += 1

    def block(self, codes: str, audits: list[str], exits: list[int], costs: list[int]) -> None:
        self.inserted()
        if self.cost is None:
            self.cost = costs[0]
        for c in codes:
            self.faults[(ord(c) - ord("A")) % 4] += 1
        self.edits, self.at = audits[self.state], 0
        self.audit.append(self.edits)

    def row(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        if self.role is not None and self.role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            given, self.state = next((r, to) for r, to in NEXT[self.state].items() if r in NAMES)
            self.say(NAMES[given], text)
        elif edit == "K":
            self.state = NEXT[self.state][initial]
            self.say(role, text)

    def result(self) -> tuple:
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost or 0, "".join(self.audit), self.hash.hexdigest()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and rows of each conversation in order: its counts, cost, audit and the hash of what it reads repaired."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    conv, chat, kind = object(), None, None
    for b in slices(batches):
        kind, out = b.schema.field(0).type, []
        for c, _, part, turn, role, _, text, copies, codes, audits, exits, costs in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if chat is None or c != conv:
                if chat:
                    out.append((conv, *chat.result()))
                conv, chat = c, _Chat()
            if part == 0:
                chat.block(codes, audits, exits, costs)
            else:
                for _ in range(copies):
                    chat.row(turn, role, text)
        yield _table(out, names, kind)
    if chat:
        yield _table([(conv, *chat.result())], names, kind)


def _table(rows: list[tuple], names: list[str], kind) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def repaired(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, copies)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    said = rows.select("conv_id", block_of(turns).alias("block"), F.lit(1).alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies", none("string").alias("codes"), none("array<string>").alias("audits"), none("array<int>").alias("exits"), none("array<long>").alias("costs"))
    held = audits(rows, turns).select("conv_id", "block", F.lit(0).alias("part"), none("bigint").alias("turn"), none("string").alias("role"), none("string").alias("digest"), none("string").alias("text"), F.lit(0).alias("copies"), "codes", "audits", "exits", "costs")
    both = said.unionByName(held).repartition("conv_id").sortWithinPartitions("conv_id", "block", "part", *ORDER)
    return both.mapInArrow(_told, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def digest(chats: DataFrame, turns: int = TURNS) -> DataFrame:
    """The query: damage by hash, then repair."""
    return repaired(damaged(chats), turns)
