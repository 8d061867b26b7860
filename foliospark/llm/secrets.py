"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's regex a Boolean trigram query is derived: what every match must contain, as an AND of clauses, each an OR
of ANDs of trigrams of the ASCII-lower-cased text. Postings (trigram, doc_id) are built for the trigrams that the queries mention, and
intersected per document by an aggregate; documents that satisfy a rule's query are its candidates. Only candidates are
verified with the regex. Rules without a mandatory trigram (a run of hex digits has none) scan every document.

Spans are counted in code points, end exclusive. Spark has no regex function that returns places, so they follow from
the lengths of the matches and of the text between them (split by the same regex). Null text counts as empty.
Documents whose id is null or repeated are handled row by row: a repeated id's postings are united, which can only add
candidates, and rows of a null id are candidates of every rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A set of alternatives larger than this is no longer carried as exact strings.
MOST_EXACT = 32


@dataclass(frozen=True)
class Rule:
    """group: the group whose length `least` bounds (0: the whole match). base: part of the base contract."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds in the order in which they are listed. The runs of hex and access are maximal, so that
#: asking for the least length inside the regex finds the same spans as dropping short matches does.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
)
#: Kinds that the method adds.
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def query(regex: str) -> tuple[frozenset[frozenset[str]], ...]:
    """The Boolean query of a regex: clauses that all hold, each an OR (outer) of ANDs (inner) of lower-case trigrams; none if nothing is mandatory.

    The regex is read from left to right with the set of exact strings that the part so far can end in. Where that set can
    no longer be kept, what it demands is added to the query and a new set begins.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def flush(exact: set[str]) -> None:
        if exact and all(len(s) >= 3 for s in exact):
            clauses.append(frozenset(trigrams(s) for s in exact))

    def strings(item) -> set[str] | None:
        """The finite set of strings of an item, None if it is too large."""
        op, av = item
        if op is C.LITERAL:
            return {chr(av).lower()}
        if op is C.IN:
            out: set[str] = set()
            for o, v in av:
                if o is C.LITERAL:
                    out.add(chr(v).lower())
                elif o is C.RANGE and v[1] - v[0] < 4:
                    out |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is C.SUBPATTERN:
            return sequence(av[3])
        if op is C.BRANCH:
            parts = [sequence(p) for p in av[1]]
            return None if None in parts or sum(map(len, parts)) > MOST_EXACT else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[1] <= 2:
            inner = sequence(av[2])
            return None if inner is None or len(inner) > 2 else {"".join(x) for n in range(av[0], av[1] + 1) for x in product(inner, repeat=n)}
        return {""} if op is C.AT else None

    def sequence(items) -> set[str] | None:
        out = {""}
        for item in items:
            more = strings(item)
            if more is None or len(out) * len(more) > MOST_EXACT:
                return None
            out = {a + b for a in out for b in more}
        return out

    exact = {""}
    for item in _parser.parse(regex):
        more = strings(item)
        if more is None or len(exact) * len(more) > MOST_EXACT:
            flush(exact)
            exact = more if more is not None and len(more) <= MOST_EXACT else {""}
        else:
            longer = {a + b for a in exact for b in more}
            if "" in more and len(more) > 1 and all(len(s) >= 3 for s in exact):
                flush(exact)  # an optional part after a full clause would weaken nothing: the clause stands
                longer = {""}
            exact = longer
    flush(exact)
    return tuple(dict.fromkeys(clauses))


def folded(text: Column) -> Column:
    """ASCII letters in lower case, all else as it is: lower() would turn some other letters into ASCII ones."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rules): for each document with a candidate rule that has a query, the kinds of those rules."""
    queries = {r.kind: q for r in rules if (q := query(r.regex))}
    grams = sorted({t for q in queries.values() for clause in q for a in clause for t in a})
    text = F.col("_folded")
    present = F.filter(F.array(*[F.when(F.contains(text, F.lit(t)), F.struct(F.lit(i // 60).alias("w"), F.lit(1 << i % 60).cast("bigint").alias("bit"))) for i, t in enumerate(grams)]), lambda x: x.isNotNull())
    postings = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("_folded")).select("doc_id", F.explode(present).alias("gram"))  # gram: its word of the bitmap and its bit there
    # The intersection: which of the mentioned trigrams a document has, one bit each, united where a doc_id repeats.
    words = -(-len(grams) // 60)
    held = postings.groupBy("doc_id").agg(*[F.bit_or(F.when(F.col("gram.w") == w, F.col("gram.bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(words)])

    def all_of(needed: frozenset[str]) -> Column:
        parts = []
        for w in range(words):
            mask = sum(1 << (i - 60 * w) for i, t in enumerate(grams) if t in needed and 60 * w <= i < 60 * w + 60)
            if mask:
                parts.append(F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("bigint")) == F.lit(mask).cast("bigint"))
        return _fold(parts, lambda a, b: a & b)

    def one_of(clause: frozenset[frozenset[str]]) -> Column:
        return _fold([all_of(a) for a in sorted(clause, key=sorted)], lambda a, b: a | b)

    hits = [F.when(_fold([one_of(c) for c in q], lambda a, b: a & b), F.lit(kind)) for kind, q in queries.items()]
    return held.select("doc_id", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("rules")).where(F.size("rules") > 0)


def _fold(cols, how):
    out = cols[0]
    for c in cols[1:]:
        out = how(out, c)
    return out


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start int, end int>> of the rule's matches that are long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    sizes = F.transform(found, F.length)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    held = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.length) if rule.group else sizes
    rows = F.arrays_zip(sizes.alias("size"), F.slice(gaps, 1, F.size(sizes)).alias("gap"), held.alias("held"))
    return F.transform(F.filter(_placed(rows), lambda x: x["held"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


#: Matches that are summed up at a time: appending to a list copies it, so lists are kept short.
RUN = 128


def _placed(rows: Column) -> Column:
    """array<struct<start, end, held>> from array<struct<size, gap, held>>: the running sums, first over runs of RUN rows and then within each."""
    runs = F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(rows) / RUN).cast("int")), lambda i: i * RUN < F.size(rows)), lambda i: F.slice(rows, i * RUN + 1, RUN))

    def within(run: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<struct<start:int,end:int,held:int>>").alias("out"))

        def step(acc, r):
            begin, end = acc["at"] + r["gap"], acc["at"] + r["gap"] + r["size"]
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), r["held"].alias("held"))).alias("out"))

        return F.aggregate(run, start, step)["out"]

    def based(held: Column) -> Column:
        lengths = F.transform(held, lambda run: F.aggregate(run, F.lit(0), lambda n, r: n + r["gap"] + r["size"]))
        begun = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
        return F.flatten(F.transform(F.arrays_zip(held.alias("run"), begun.alias("base")), lambda x: within(x["run"], x["base"])))

    return F.get(F.transform(F.array(runs), based), F.lit(0))


def _named(spans: Column, k: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and found: array<struct<start, k, kind, end>> of all spans, by start, then by the rules' order. A column `found` of the caller's gives way."""
    names = {r.kind: k for k, r in enumerate(rules)}
    apart = F.struct(F.col("doc_id").alias("id"), "rules").alias("_of")
    asked = candidates(docs, rules, id_col, text_col).select(apart).alias("_candidates")
    joined = docs.join(asked, docs[id_col] == F.col("_candidates._of.id"), "left")
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = []
    for r in rules:
        has = F.array_contains(F.col("_candidates._of.rules"), r.kind) | docs[id_col].isNull() if query(r.regex) else F.lit(True)
        found = _named(spans_of(text, r), names[r.kind], r.kind)
        parts.append(F.when(has & F.regexp_like(text, F.lit(r.regex)), found).otherwise(F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>")))
    return joined.select(*[docs[c] for c in docs.columns if c != "found"], F.array_sort(F.concat(*parts)).alias("found"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""
    found = F.col("found")
    base = F.filter(found, lambda x: x["k"] < len(BASE))
    counts = [F.size(_of_kind(found, r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return scan(picked).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(found).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by [REDACTED]."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        found,
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("[REDACTED]"))).alias("out"),
        ),
    )
    return F.when(F.size(found) == 0, text).otherwise(F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text))))
