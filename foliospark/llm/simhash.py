"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints: a document's words are lower-cased (A-Z), its word shingles (repeats included) hashed by XXH64 with seed 42,
and bit i of the fingerprint is set if it is set in over half of the hashes. Fewer words than a shingle: the whole
sequence is the one shingle; none (null, empty or blank text): fingerprint zero, which links like any other.

Links: fingerprints that differ in at most `radius` bits. The 64 bits are cut into `segments`; two fingerprints within the
radius differ by at most radius // segments bits in one of them. So a table holds each distinct fingerprint under each of its
segments' values, every fingerprint asks for the small Hamming ball around each of its own, and what the table answers
is verified by the complete distance. Where the ball has radius one, a key with one bit set additionally is asked for only
by the side that has a zero there, so each pair is found from one side.
Equal fingerprints are merged before that, so copies never make pairs. Components: rounds of pointer jumping contract
the links, so that each round has fewer; labels and links are cut to the shared checkpoint folder each round and nothing
but whether any are left goes to the driver.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_sample, cut, drop, slices

SEED = 42
#: Shingle hashes whose bits are unpacked at a time.
BITS_AT_ONCE = 1 << 16
#: Texts of the sample by which shingles are ordered, and the most shingles that it calls common.
SAMPLE_TEXTS, COMMON = 8000, 50_000
#: Rounds in which sets are compared with one of their key, and by how many orders that one is chosen.
STAR_ROUNDS, STAR_ORDERS = 2, 8
#: Words of 64 bits, each bit the parity of how many shingles fall on it: sets differ in as many shingles as bits at least.
PARITY = [f"p{i}" for i in range(8)]
#: Sets of more shingles have wide parities too, a bit for each shingle at least: unlike sets of more than about 1150 differ in no more bits of PARITY than alike ones may.
WIDE_FROM = 1000
#: Bits of the map by which texts are looked over before they are shuffled.
MAP_BITS = 1 << 23


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    return np.fromiter([h(whole[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)], np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[a : a + BITS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def remixed(hashes: np.ndarray, t: int) -> np.ndarray:
    """The hashes of table t: those of table 0 as they are, others mixed anew, so that their bits are independent."""
    if t == 0:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (t + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 3, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; a row for each table t."""

    def run(batches):
        for b in slices(batches):
            hashes = [shingle_hashes(x, size) for x in b.column(1).to_pylist()]
            for t in range(tables):
                fp = np.array([fingerprint(remixed(h, t)) for h in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array(np.full(len(fp), t, np.int32))], ["doc_id", "fp", "t"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint, t int")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    ends = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _value(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) if width < 64 else fp


def _ball(segment: int, own, width: int, radius: int) -> list:
    """Arrays of the keys (s, v) that a segment's value asks for."""

    def key(value):
        return F.struct(F.lit(segment).alias("s"), value.alias("v"))

    out = [F.array(key(own))]
    for k in range(1, radius + 1):
        masks = F.array(*[F.lit(sum(1 << b for b in bits)).cast("bigint") for bits in combinations(range(width), k)])
        if radius == 1:
            masks = F.filter(masks, lambda m: own.bitwiseAND(m) == 0)
        out.append(F.transform(masks, lambda m: key(own.bitwiseXOR(m))))
    return out


def _within(differing, radius: int, segments: int, ball: int):
    """Whether links() finds a pair, from the bits in which its fingerprints differ."""
    close = [F.bit_count(_value(differing, *s)) <= ball for s in _segments(segments)]
    return (F.bit_count(differing) <= radius) & reduce(lambda x, y: x | y, close)


def links(fps: DataFrame, radius: int = 3, segments: int = 2, ball: int | None = None, earlier: tuple = ()) -> DataFrame:
    """Pairs (a, b) of distinct values of fps.fp (bigint) at distance 1 to radius, in either order.

    A pair that several segments would find is left to the first of them.
    ball: the radius asked for within a segment. From radius // segments on, which is the default, no pair is missed; a
    smaller one finds all pairs up to segments * (ball + 1) - 1 bits and, of those further apart, the ones that are close in a segment.
    earlier: columns of fps with fingerprints of other tables, null where that table has no such row; pairs that those find are left out.
    """
    fp = F.col("fp")
    ball = radius // segments if ball is None else ball
    held = F.array(*[F.struct(F.lit(i).alias("s"), _value(fp, *s).alias("v")) for i, s in enumerate(_segments(segments))])
    asks = [ask for i, (shift, width) in enumerate(_segments(segments)) for ask in _ball(i, _value(fp, shift, width), width, ball)]
    table = fps.select(fp.alias("b"), *[F.col(e).alias(f"b_{e}") for e in earlier], F.explode(held).alias("k")).select("*", "k.s", "k.v").drop("k")
    asked = fps.select(fp.alias("a"), *[F.col(e).alias(f"a_{e}") for e in earlier], F.explode(F.concat(*asks)).alias("k")).select("*", "k.s", "k.v").drop("k")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(differing) <= radius)
    for i, s in enumerate(_segments(segments)[:-1]):
        near = near & ((asked.s <= i) | (F.bit_count(_value(differing, *s)) > ball))
    for e in earlier:
        near = near & ~F.coalesce(_within(F.col(f"a_{e}").bitwiseXOR(F.col(f"b_{e}")), radius, segments, ball), F.lit(False))
    return asked.join(table, (asked.s == table.s) & (asked.v == table.v) & near).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(fp, label) of each value in pairs(a, b) that is in a pair of two: the least value (as signed) reachable over the links.

    Each round every value takes the least of its neighbours, pointer jumping leads it to a local minimum, and the links
    between those minima, at most half as many values, are the next round's.
    """
    links = cut(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        ends = links.select(F.col("u").alias("fp"), F.col("v").alias("other")).union(links.select("v", "u"))
        step = cut(ends.groupBy("fp").agg(F.least(F.min("other"), F.col("fp")).alias("up")).withColumn("old", F.lit(None).cast("bigint")), "up")
        moved = True
        while moved:
            last, far = step, step.select(F.col("fp").alias("up"), F.col("up").alias("far"))
            step = cut(last.select("fp", "up").join(far, "up").select("fp", F.col("far").alias("up"), F.col("up").alias("old")), "up")
            drop(last)
            moved = not step.where("up < old").isEmpty()
        up = step.select("fp", "up")
        if state is None:
            state = cut(up.withColumnRenamed("up", "label"), "labels")
        else:
            last = state
            state = cut(last.join(up.withColumnRenamed("fp", "label"), "label", "left").select("fp", F.coalesce("up", "label").alias("label")), "labels")
            drop(last)
        last = links
        u, v = up.select(F.col("fp").alias("u"), F.col("up").alias("x")), up.select(F.col("fp").alias("v"), F.col("up").alias("y"))
        kept = last.join(u, "u").join(v, "v").where("x <> y")
        links = cut(kept.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        drop(last, step)
        if links.isEmpty():
            return state


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, its own included).

    Null doc_ids keep their row; a component of null doc_ids alone has a null component_id. Repeated doc_ids keep all rows.
    """
    each = cut(fingerprints(docs, size, id_col=id_col, text_col=text_col).select("doc_id", "fp"), "fingerprints")
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(classes.select("fp"), radius, segments))
    # Of the classes that have links, the smallest doc_id of each component.
    linked = classes.join(label, "fp")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of = classes.join(label.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = each.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes, ascending, that several texts of a bounded sample hold, and how many of them do. docs: (doc_id, text)."""

    def run(batches):
        for b in slices(batches):
            for t in b.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, size)).view(np.int64))], ["sh"])

    counts = bounded_sample(docs, "doc_id", SAMPLE_TEXTS).mapInArrow(run, "sh bigint").groupBy("sh").count().where("count > 2")
    got = counts.orderBy(F.desc("count"), "sh").limit(COMMON).collect()
    sh = np.array([r[0] for r in got], np.int64).view(np.uint64)
    order = np.argsort(sh)
    return sh[order], np.array([r[1] for r in got], np.int64)[order]


def _prefixes(keyed: DataFrame, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, h1, h2, n, s1, s2, fp, keys, wide, PARITY): a text's count of distinct shingles, a hash pair, the fingerprint, the prefix and the parities of their set.

    The prefix is what comes first in an order of all shingles that is the same for all texts: those least common in the sample,
    then by hash. Two sets of at least the similarity have a shingle of both prefixes in common, whatever the order.
    """
    held, count = common

    def run(batches):
        for b in slices(batches):
            n, s1, s2, fp, keys, wide, odd = [], [], [], [], [], [], []
            for t in b.column(3).to_pylist():
                sh = np.unique(shingle_hashes(t, size))
                digest = xxhash.xxh3_128_intdigest(sh.tobytes())
                rank = np.zeros(len(sh), np.int64)
                if len(held):
                    at = np.minimum(np.searchsorted(held, sh), len(held) - 1)
                    rank = np.where(held[at] == sh, count[at], 0)
                first = np.lexsort((sh, rank))[: len(sh) - _least(similarity * len(sh)) + 1]
                n.append(len(sh))
                s1.append(digest >> 64)
                s2.append(digest & (1 << 64) - 1)
                fp.append(fingerprint(sh))
                keys.append(sh[first].view(np.int64))
                wide.append(parities(sh, 1 << (len(sh) - 1).bit_length()) if len(sh) > WIDE_FROM else None)
                odd.append(parities(sh, 64 * len(PARITY)))
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2, fp)]
            parity = [pa.array(x) for x in np.array(odd, np.int64).reshape(-1, len(PARITY)).T.copy()]
            columns = [*b.columns[:3], pa.array(n, pa.int32()), *hashes, *[pa.array(x, pa.list_(pa.int64())) for x in (keys, wide)], *parity]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n", "s1", "s2", "fp", "keys", "wide", *PARITY])

    schema = "doc_id bigint, h1 bigint, h2 bigint, n int, s1 bigint, s2 bigint, fp bigint, keys array<bigint>, wide array<bigint>"
    return keyed.select("doc_id", "h1", "h2", "text").mapInArrow(run, ", ".join([schema, *[f"{p} bigint" for p in PARITY]]))


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits, each bit the parity of how many hashes fall on it. Of half as many bits they are the two halves' exclusive or."""
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.int64)


def _least(x: float) -> int:
    """x rounded up, unless it is above an integer only by a rounding error."""
    return math.ceil(x - 1e-9)


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, sh): the distinct shingle hashes of each text. texts: (id, text)."""

    def run(batches):
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "sh"])

    return texts.mapInArrow(run, "id bigint, sh array<bigint>")


def _among(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows but for most of those whose columns `on` are not among wanted's: a map of MAP_BITS bits, however large the tables, lets those few through that fall on a bit of another."""
    place = F.pmod(F.xxhash64(*on), F.lit(MAP_BITS))
    word, bit = F.shiftright(place, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    bits = wanted.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(bits), word == bits["_word"]).where(bit.bitwiseAND(bits["_bits"]) != 0).select(*rows.columns)


def _alike(asked: DataFrame, nodes: DataFrame, keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (x, y) of asked, as (a, b), whose shingle sets have at least the Jaccard similarity."""
    ends, row = asked.select(F.col("x").alias("id")).union(asked.select("y")).distinct(), ["doc_id", "h1", "h2"]
    wanted = cut(nodes.select("id", *row).join(ends, "id"), "wanted")
    texts = _among(keyed, wanted, row).join(wanted, row).dropDuplicates(row)
    sets = cut(_shingle_sets(texts.select("id", "text"), size), "sets")
    both = asked.join(sets.select(F.col("id").alias("x"), F.col("sh").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("sh").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    out = cut(both.where(shared >= similarity * (F.size("sx") + F.size("sy") - shared) - 1e-9).select(F.col("x").alias("a"), F.col("y").alias("b")), "alike")
    drop(wanted, sets)
    return out


def _differ():
    """Bits in which the parities of two postings x and y differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in PARITY])


def _may_differ(bits, both, similarity: float):
    """Whether sets of `both` shingles together may have the similarity, though their parities differ in so many bits."""
    return bits * (1 + similarity) <= (1 - similarity) * both + 1e-9


def _may_be_alike(similarity: float):
    """Of two postings x and y of a key, whether their sets may have the similarity.

    False only if the sizes or the parities rule it out, or the key's places, were it the first that both have: at that first key alike sets pass.
    """
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    sizes = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9
    both = F.col("x.n") + F.col("y.n")
    return sizes & (most * (1 + similarity) >= similarity * both - 1e-9) & _may_differ(_differ(), both, similarity)


def _still_close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y, far and others) but for those of long sets that their wide parities rule out; far, the share of bits that differ, is then that of the wide ones.

    So the sets themselves, many times as large, are joined to pairs that are nearly all alike. Parities of two widths are compared at the smaller, unless one is more than twice the other.
    """
    wide = nodes.where("wide IS NOT NULL")
    of = lambda end: wide.select(F.col("id").alias(end), F.col("n").alias(f"_n{end}"), F.col("wide").alias(f"_w{end}"))
    both = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    xor = lambda a, b: a.bitwiseXOR(b)

    def at_most(own, other):
        half = F.size(own) / 2
        halves = [F.slice(own, F.lit(1), half.cast("int")), F.slice(own, half.cast("int") + 1, half.cast("int"))]
        return F.when(F.size(own) > F.size(other), F.zip_with(*halves, xor)).otherwise(own)

    x, y = at_most(F.col("_wx"), F.col("_wy")), at_most(F.col("_wy"), F.col("_wx"))
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda a, b: a + b)
    near = (F.size("_wx") <= 2 * F.size("_wy")) & (F.size("_wy") <= 2 * F.size("_wx"))
    told = both.withColumn("_bits", F.when(F.col("_wx").isNotNull() & F.col("_wy").isNotNull() & near, differ))
    left = told.where(F.col("_bits").isNull() | _may_differ(F.col("_bits"), F.col("_nx") + F.col("_ny"), similarity))
    return left.withColumn("far", F.coalesce(F.col("_bits") / (F.col("_nx") + F.col("_ny")), "far")).select(*pairs.columns)


def _labelled(postings: DataFrame, label: DataFrame) -> DataFrame:
    """The postings with the component of each id, of the keys that hold several components."""
    own = postings.join(label.withColumnRenamed("fp", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return own.join(mixed, "key", "left_semi")


def _fingerprint_pairs(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """(x, y) of nodes(id, fp) that multi-index hashing finds: those of a fingerprint with its least id, and of each fingerprint that has links the least id with that of its least partner.

    So there are at most as many pairs as nodes, however dense a group is.
    """
    classes = nodes.groupBy("fp").agg(F.min("id").alias("least"))
    same = nodes.join(classes, "fp").where("id > least").select(F.col("least").alias("x"), F.col("id").alias("y"))
    found = cut(links(classes.select("fp"), radius, segments), "links")
    ends = found.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(found.select("b", "a"))
    partner = ends.groupBy("fp").agg(F.min("other").alias("other"))
    near = partner.join(classes, "fp").withColumnRenamed("least", "x").join(classes.select(F.col("fp").alias("other"), F.col("least").alias("y")), "other")
    out = cut(same.union(near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct(), "found")
    drop(found)
    return out


def _set_components(nodes: DataFrame, keyed: DataFrame, size: int, similarity: float, radius: int, segments: int) -> DataFrame:
    """(fp, label) of the nodes that pairs of at least the similarity join to others. nodes: (id, doc_id, h1, h2, n, fp, keys, wide, PARITY).

    First the pairs that the fingerprints find are verified. Then, in STAR_ROUNDS, the sets that share a key and are in different components are compared with one
    of them, which joins dense groups without expanding them. Which one is the first in one of STAR_ORDERS orders, by the key, as many sets of a
    dense group may be unlike any single one of it. At last all pairs that share a key and are still in different components are candidates, so no pair is missed that would
    join two. Of those between the same two components the one whose parities differ least is compared first, and the others only if the components are apart after that.
    """
    found = _fingerprint_pairs(nodes, radius, segments)
    asked = cut(_still_close(found.withColumn("far", F.lit(0.0)), nodes, similarity), "candidates")
    drop(found)
    edges = _alike(asked, nodes, keyed, size, similarity)
    label = components(edges)
    drop(asked)
    each = nodes.select("id", "n", F.posexplode("keys").alias("pos", "key"))
    shared = each.groupBy("key").count().where("count > 1").select("key")
    postings = cut(each.join(shared, "key", "left_semi"), "postings")
    for step in (*range(STAR_ROUNDS), "all"):
        own = cut(_labelled(postings, label).join(nodes.select("id", *PARITY), "id"), "labelled")
        x, y = own.alias("x"), own.alias("y")
        where = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & _may_be_alike(similarity)
        if step == "all":
            where = where & (F.col("x.id") < F.col("y.id"))
        else:
            ranked = own.withColumn("rank", F.xxhash64(F.lit(step), F.pmod("key", F.lit(STAR_ORDERS)), "id"))
            x = ranked.join(ranked.groupBy("key").agg(F.min("rank").alias("rank")), ["key", "rank"], "left_semi").alias("x")
        ends = [f("x.id", "y.id").alias(c) for f, c in ((F.least, "x"), (F.greatest, "y"))] + [f("x.label", "y.label").alias(c) for f, c in ((F.least, "lx"), (F.greatest, "ly"))]
        pair = x.join(y, where).select(*ends, (_differ() / (F.col("x.n") + F.col("y.n"))).alias("far")).distinct()
        asked = cut(_still_close(pair, nodes, similarity), "candidates")
        if step == "all":
            first = cut(asked.groupBy("lx", "ly").agg(F.min(F.struct("far", "x", "y")).alias("of")).select("of.x", "of.y"), "candidates")
            edges = edges.union(_alike(first, nodes, keyed, size, similarity))
            label = components(edges)
            at = lambda end: label.select(F.col("fp").alias(end), F.col("label").alias(f"_l{end}"))  # noqa: E731, B023
            apart = F.coalesce("_lx", "x") != F.coalesce("_ly", "y")
            others = asked.join(first, ["x", "y"], "left_anti").join(at("x"), "x", "left").join(at("y"), "y", "left").where(apart).select("x", "y")
            rest = cut(others, "candidates")
            drop(asked, first)
            asked = rest
        edges = edges.union(_alike(asked, nodes, keyed, size, similarity))
        label = components(edges)
        drop(own, asked)
    drop(postings)
    return label


def text_hashes(text) -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def verified_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2, component_id) of the texts that a chain of pairs of at least the similarity joins to another document; others have no row.

    The similarity is the Jaccard similarity of the sets of shingles of `size` words. Candidates are what multi-index hashing finds within `radius` bits of
    the sets' fingerprints; pairs of that similarity often differ in more bits than any table can be asked for, so an exact join by prefixes
    follows for the sets that are still apart and no pair is missed, see _prefixes and _set_components. h1 and h2 are the text's hashes (text_hashes), and each text of a repeated
    doc_id is in its own group; component_id is the smallest doc_id of the group. Texts without shingles are only alike if equal. Null doc_ids take no part.
    """
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id IS NOT NULL")
    keyed = own.select("doc_id", "text", *text_hashes(F.col("text")))
    prefixes = cut(_prefixes(keyed, size, similarity, _common(own, size)), "prefixes")
    nodes = cut(prefixes.where("n > 0").dropDuplicates(["s1", "s2"]).withColumn("id", F.monotonically_increasing_id()), "nodes")
    # Texts without shingles are their own nodes by their hash pair; those of a set share its hash pair.
    texts = cut(prefixes.select("doc_id", "h1", "h2", F.expr("if(n > 0, s1, h1)").alias("s1"), F.expr("if(n > 0, s2, h2)").alias("s2"), F.expr("n > 0").alias("full")), "texts")
    drop(prefixes)
    label = _set_components(nodes, keyed, size, similarity, radius, segments)
    joined = nodes.select("s1", "s2", "id").join(label.withColumnRenamed("fp", "id"), "id").select("s1", "s2", F.lit(True).alias("full"), "label")
    of = cut(texts.join(joined, ["s1", "s2", "full"], "left").select("doc_id", "h1", "h2", "label", *[F.when(F.col("label").isNull(), F.col(c)).alias(c) for c in ("s1", "s2", "full")]), "grouped")
    group = ["label", "s1", "s2", "full"]
    sizes = of.groupBy(group).agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("_last")).where("component_id < _last").drop("_last")
    same = [of[c].eqNullSafe(sizes[c]) for c in group]
    return of.join(sizes, same).select("doc_id", "h1", "h2", "component_id").distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text's group holds a smaller doc_id. Of a repeated doc_id, each row stays or goes by its own text."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = verified_groups(docs, **options).where("doc_id <> component_id").select(F.struct("doc_id", "h1", "h2").alias("of")).alias("_twins")
    h1, h2 = text_hashes(docs[text_col].cast("string"))
    of = F.col("_twins.of")
    return docs.join(gone, (docs[id_col].cast("bigint") == of["doc_id"]) & (h1 == of["h1"]) & (h2 == of["h2"]), "left_anti")
