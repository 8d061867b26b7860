"""Best-fit packing of documents into training sequences under conflicts.

A sequence (bin) holds `capacity` units. Documents are dealt to shards by a hash of their id, about `shard_rows` rows
each, so that a hot source or a large group of copies is spread over all shards and a shard's size doesn't grow with the
input. In a shard, pieces are placed in the order of falling length (ties: smaller doc_id first, nulls first). Open bins
are ordered by residual space, then by number. The successor search starts at the least residual that fits and goes on until
it finds a bin that is compatible: a bin carries a bitmap of the sources that have reached `per_source` pieces in it and
one of its duplicate clusters, and takes no further piece of either. If none is compatible a new bin is opened.

Documents longer than a bin are cut: full pieces have a bin of their own each, the rest is placed like a short document.
Documents of length 0 or null take no space: one row with n_units 0 and no bin. A null source is a source of its own and
a null cluster never conflicts. Repeated doc_ids are separate pieces, and conflict if their clusters are equal.
Only ids, lengths, sources and cluster keys are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, piece int, start_unit bigint, n_units bigint, bin_id string, bin_offset bigint"
NAMES = ["doc_id", "piece", "start_unit", "n_units", "bin_id", "bin_offset"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 2, 4096


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece (1 to capacity units, in the order of placing). clusters: -1 never conflicts."""
    twice: dict[int, int] = {}
    for c in clusters:
        if c >= 0:
            twice[c] = twice.get(c, 0) + 1
    bit: dict[int, int] = {c: 1 << i for i, c in enumerate(c for c, n in twice.items() if n > 1)}  # single ones can't conflict
    free: list[tuple[int, int]] = []  # (residual, bin), ordered
    full_sources: list[int] = []
    held_clusters: list[int] = []
    counts: list[dict[int, int]] = []
    bins, offsets = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        s_bit, c_bit = 1 << s, bit.get(c, 0)
        at = bisect_left(free, (n, -1))
        while at < len(free):
            b = free[at][1]
            if not (full_sources[b] & s_bit or held_clusters[b] & c_bit):
                break
            at += 1
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(counts)
            full_sources.append(0)
            held_clusters.append(0)
            counts.append({})
        bins.append(b)
        offsets.append(capacity - room)
        held_clusters[b] |= c_bit
        counts[b][s] = k = counts[b].get(s, 0) + 1
        if k >= per_source:
            full_sources[b] |= s_bit
        if room > n:
            insort(free, (room - n, b))
    return bins, offsets


def best_fit(docs: DataFrame, length, cluster, id_col: str = "doc_id", source_col: str = "source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per piece. length: column of units per document; cluster: bigint column of its duplicate cluster.

    bin_id names the shard and the bin; start_unit is where the piece begins in its document, bin_offset where in its bin.
    """
    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0)).alias("n"), cluster.cast("bigint").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    # Rows of one doc_id may repeat: the length and cluster are part of what deals them out.
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "cluster", "source"), F.lit(shards)).cast("int"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        least = -(1 << 70)  # nulls sort first
        got = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster")), strict=True), key=lambda r: (least if r[0] is None else r[0], least if r[3] is None else r[3], r[1] or "", r[1] is None))
        out, short = [], []
        for doc, source, n, cluster in got:
            whole, rest = divmod(n, capacity)
            out += [(doc, k, k * capacity, capacity, None, 0) for k in range(whole)]
            if rest:
                short.append((rest, doc, source, cluster, whole))
            elif not whole:
                out.append((doc, 0, 0, 0, None, None))
        out = [(*r[:4], f"{shard}-f{i}" if r[3] else None, r[5]) for i, r in enumerate(out)]
        short.sort(key=lambda r: -r[0])  # stable: ties keep the order above
        source_no = {x: i for i, x in enumerate(dict.fromkeys(r[2] for r in short))}
        cluster_no = {x: i for i, x in enumerate(dict.fromkeys(r[3] for r in short))} | {None: -1}
        bins, offsets = pack([r[0] for r in short], [source_no[r[2]] for r in short], [cluster_no[r[3]] for r in short], capacity, per_source)
        out += [(doc, whole, whole * capacity, rest, f"{shard}-{b}", at) for (rest, doc, _, _, whole), b, at in zip(short, bins, offsets, strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """best_fit over words of the text; documents of equal text are one duplicate cluster, empty texts none."""
    words = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return best_fit(docs, words, F.xxhash64(docs[text_col]), id_col, source_col, **options)
