"""Chunks of books that are larger than a row: the greedy rules of ingest.chunk_records() over a table of paragraphs, in any number of tasks.

Of a walk that comes to a block of paragraphs only the words of the open chunk matter, and above `most` all alike. So a block is a table from
that state to the state behind it and to the number of chunks that begin in it: within the block each paragraph's successor is found by search over prefix sums,
and the states' ends follow from the last paragraph to the first. Tables of successive blocks are composed, blocks of blocks as far as need be; then the states go
down again, and each block, with its own, marks its chunks' starts by itself. Paragraphs' numbers and flags are shuffled twice, by block, their texts not
at all for that. No array is longer than a block, a block's table has most + 3 entries, and no task holds a book.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import scans
from foliospark.storage import dropped, kept

NEVER = 1 << 40
#: A state is 0 where no chunk is open, else 1 and the words of the open chunk, most + 1 for all above most.
TABLE = "exits array<int>, begun array<bigint>"


def facts(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """(book, i, w, c, chapter, scene, part, ends, toc, front, head): what the rules ask of paragraphs (key, para_no, text); head: the text of parts and chapters. Null keys are no book, null texts empty paragraphs."""
    t = F.coalesce("text", F.lit(""))
    return paras.where(F.col(key).isNotNull()).select(
        F.col(key).alias("book"), F.col("para_no").cast("bigint").alias("i"), T.word_count(t).alias("w"), F.length(t).cast("bigint").alias("c"), t.rlike(T.CHAPTER).alias("chapter"), t.rlike(T.SCENE_BREAK).alias("scene"),
        t.rlike(T.PART).alias("part"), (F.right(t, F.lit(1)).isin(".", '"', "'") | T.stripped_heading(t)).alias("ends"), T.is_toc_like(t).alias("toc"), T.is_front_matter(t).alias("front"),
        F.when(t.rlike(T.CHAPTER) | t.rlike(T.PART), t).alias("head"),
    )


class Block:
    """Successive paragraphs: where chunks close that are open among them."""

    def __init__(self, w: np.ndarray, chapter: np.ndarray, scene: np.ndarray, ends: np.ndarray, least: int, target: int, most: int):
        self.sums, self.size, self.most = np.concatenate([[0], np.cumsum(w, dtype=np.int64)]), len(w), most
        plain = ~chapter & ~scene
        # What closes a chunk: a chapter or scene break before it is added, a paragraph too many, a paragraph that ends a sentence after it is added.
        kinds = ((chapter, 0, least), (scene & ~chapter, 0, target), (plain, 1, most + 1), (plain & ends, 1, target))
        self.kinds = [(at := np.flatnonzero(where), self.sums[at + own], need) for where, own, need in kinds]
        self.before, self.full = self.closing(np.arange(self.size), self.sums[:-1], 1)
        self.next = np.minimum(self.before, self.full)

    def closing(self, first: np.ndarray, base: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(before, full): where chunks close before a paragraph or after one, if the words of each are the sums less its base. own: 1 if the chunk has no paragraph before `first`."""
        hits = []
        for k, (at, words, need) in enumerate(self.kinds):
            place = np.maximum(np.searchsorted(words, base + need), np.searchsorted(at, first + (own if k < 3 else 0)))
            hits.append(np.append(at, NEVER)[place])
        return np.minimum.reduce(hits[:3]), hits[3] + 1

    def entered(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """closing() of a chunk that is open at the first paragraph with so many words."""
        return self.closing(np.zeros(len(words), np.int64), -words, 0)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each state before the block that behind it, and how many chunks begin in it."""
        n, to = self.size, self.next.tolist()
        exits, begun = (1 + np.minimum(self.sums[-1] - self.sums[:-1], self.most + 1)).tolist(), [1] * n
        for i in range(n - 1, -1, -1):
            if to[i] < n:
                exits[i], begun[i] = exits[to[i]], begun[to[i]] + 1
            elif to[i] == n:
                exits[i] = 0
        words = np.arange(self.most + 2)
        at = np.minimum(*self.entered(words))
        inside = np.minimum(at, n - 1)
        beyond = np.where(at == n, 0, 1 + np.minimum(words + self.sums[-1], self.most + 1))
        return np.append(exits[0], np.where(at < n, np.array(exits)[inside], beyond)), np.append(begun[0], np.where(at < n, np.array(begun)[inside], 0))

    def starts(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """By paragraph whether a chunk begins there, and whether it is that paragraph which closes the chunk before."""
        start, closes, at, by = np.zeros(self.size, bool), np.zeros(self.size, bool), 0, False
        if state:
            before, full = self.entered(np.array([state - 1]))
            at, by = min(before[0], full[0]), before[0] < full[0]
        to, closed = self.next.tolist(), (self.before < self.full).tolist()
        while at < self.size:
            start[at], closes[at] = True, by
            at, by = to[at], closed[at]
        return start, closes


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows ordered by (book, b) with the bounds of each such block; a block that a batch cuts waits for its rest."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        n = rows.num_rows
        if n:
            other = [pc.not_equal(rows[c].slice(1), rows[c].slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in ("book", "b")] if n > 1 else [np.zeros(0, bool)] * 2
            edges = [0, *(np.flatnonzero(other[0] | other[1]) + 1).tolist()]
            held = rows.slice(edges[-1])
            if edges[-1]:
                yield rows.slice(0, edges[-1]), list(zip(edges, edges[1:], strict=False))
    if held is not None and held.num_rows:
        yield held, [(0, held.num_rows)]


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in names]


def _arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def tables(blocks: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """(book, b, exits, begun) of facts() by (book, b)."""

    def run(batches):
        for rows, bounds in _whole(batches):
            flags = _numbers(rows, "w", "chapter", "scene", "ends")
            made = [Block(*[x[s:e] for x in flags], least, target, most).table() for s, e in bounds]
            at = pa.array([s for s, _ in bounds])
            columns = [rows[c].combine_chunks().take(at) for c in ("book", "b")] + [_arrays([m[k] for m in made], t) for k, t in ((0, pa.int32()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["book", "b", "exits", "begun"])

    own = blocks.repartition("book", "b").sortWithinPartitions("book", "b", "i").select("book", "b", "w", "chapter", "scene", "ends")
    return own.mapInArrow(run, f"book {own.schema['book'].dataType.simpleString()}, b bigint, {TABLE}")


def states(made: DataFrame, levels: int, shift: int = scans.SHIFT) -> DataFrame:
    """(book, b, state, begun): the state in which the walk comes to each block of tables(), and how many chunks it has begun by then."""
    book = f"book {made.schema['book'].dataType.simpleString()}"
    of = F.array_sort(F.collect_list(F.struct("b", "exits", "begun")))
    groups = kept(made.groupBy("book", scans.block_of("b", shift, levels == 1).alias("above")).agg(of.alias("of")), "longbooks-tables")

    def composed(batches):
        for b in batches:
            for i in range(b.num_rows):
                exits, begun = None, None
                for x in b.column(2)[i].values.to_pylist():
                    own, n = np.array(x["exits"]), np.array(x["begun"])
                    exits, begun = (own, n) if exits is None else (own[exits], begun + n[exits])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns[:2]], _arrays([exits], pa.int32()), _arrays([begun], pa.int64())], ["book", "b", "exits", "begun"])

    def walked(batches):
        for b in batches:
            for i in range(b.num_rows):
                state, number, out = b.column(3)[i].as_py(), b.column(4)[i].as_py(), []
                for x in b.column(2)[i].values.to_pylist():
                    out.append((x["b"], state, number))
                    state, number = x["exits"][state], number + x["begun"][state]
                columns = [b.column(0).take(pa.array([i] * len(out))), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["book", "b", "state", "begun"])

    spent = [groups]
    if levels == 1:
        come = groups.select("book", "above", "of", F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("begun"))
    else:
        spent.append(states(groups.mapInArrow(composed, f"{book}, b bigint, {TABLE}"), levels - 1, shift))
        come = groups.join(spent[1].select("book", F.col("b").alias("above"), "state", "begun"), ["book", "above"]).select("book", "above", "of", "state", "begun")
    out = kept(come.mapInArrow(walked, f"{book}, b bigint, state int, begun bigint"), "longbooks-states")
    dropped(*spent)
    return out


def placed(blocks: DataFrame, entered: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """The rows of facts() by (book, b) with chunk_no and closes, whether the paragraph begins a chunk by closing the one before. entered: states()."""

    def run(batches):
        for rows, bounds in _whole(batches):
            flags = _numbers(rows, "w", "chapter", "scene", "ends")
            came, begun = _numbers(rows, "state", "begun")
            numbers, closes = [], []
            for s, e in bounds:
                start, by = Block(*[x[s:e] for x in flags], least, target, most).starts(int(came[s]))
                numbers.append(begun[s] - 1 + np.cumsum(start))
                closes.append(by)
            out = rows.drop_columns(["b", "state", "begun"]).append_column("chunk_no", pa.array(np.concatenate(numbers), pa.int64())).append_column("closes", pa.array(np.concatenate(closes)))
            yield from out.combine_chunks().to_batches()

    both = blocks.join(entered.hint("merge"), ["book", "b"]).sortWithinPartitions("book", "b", "i")
    rows = both.select("book", "b", "i", "w", "c", "chapter", "scene", "part", "ends", "toc", "front", "state", "begun")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("b", "state", "begun"))
    return rows.mapInArrow(run, f"{kinds}, chunk_no bigint, closes boolean")


def chunk_records(paras: DataFrame, key: str = "doc_id", least: int = 1200, target: int = 1800, most: int = 2200, shift: int = scans.SHIFT) -> DataFrame:
    """ingest.chunk_records() of paragraphs (key, para_no from 0 without gaps, text) that needn't fit into rows by book. An empty table has no chunks."""
    if not 0 < least <= target <= most:
        raise ValueError("0 < least <= target <= most is needed")
    own = kept(facts(paras, key), "longbooks-facts")
    levels = scans.levels_of(own, "i", shift=shift)
    blocks = own.drop("head").withColumn("b", scans.block_of("i", shift, levels == 1))
    entered = states(tables(blocks, least, target, most), max(1, levels - 1), shift)
    texts = paras.where(F.col(key).isNotNull()).select(F.col(key).alias("book"), F.col("para_no").cast("bigint").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda r: r["text"]), "\n\n")
    last = lambda flag: F.max(F.when(F.col(flag), F.col("i")))
    made = placed(blocks, entered, least, target, most).join(texts, ["book", "i"]).groupBy("book", "chunk_no").agg(
        F.concat(body, F.lit("\n")).alias("text"), F.count("*").cast("int").alias("n_paragraphs"), F.sum("w").alias("word_count"), (F.sum("c") + 2 * (F.count("*") - 1) + 1).alias("char_count"),
        last("part").alias("_part"), last("chapter").alias("_chapter"), F.max(F.when(F.col("closes") & F.col("part"), F.col("i"))).alias("_opens"), F.bool_or("toc").alias("contains_toc_like_content"), F.bool_or("front").alias("contains_front_matter"),
    )
    made = kept(made, "longbooks-chunks")
    # What comes of other chunks is gathered without the texts. A part that comes next counts as known if it, and not the chunk's own last paragraph, closes the chunk.
    before = {"start_offset": ("sum", F.col("char_count")), "_p": ("max", F.col("_part")), "_c": ("max", F.col("_chapter"))}
    known = scans.preceded(made.select("book", "chunk_no", "char_count", "_part", "_chapter"), ["book"], "chunk_no", before, levels, shift)
    opens = made.where("_opens IS NOT NULL").select("book", (F.col("chunk_no") - 1).alias("chunk_no"), "_opens")
    known = known.join(opens, ["book", "chunk_no"], "left").select("book", "chunk_no", "start_offset", F.coalesce("_opens", "_part", "_p").alias("_part"), F.coalesce("_chapter", "_c").alias("_chapter"))
    heads = own.where("head IS NOT NULL")
    for name in ("part", "chapter"):
        known = known.join(heads.select("book", F.col("i").alias(f"_{name}"), F.col("head").alias(f"{name}_hint")), ["book", f"_{name}"], "left")
    out = made.drop("_part", "_chapter", "_opens").join(known, ["book", "chunk_no"])
    end = F.col("start_offset") + F.col("char_count")
    warnings = F.array_compact(F.array(F.when(F.col("word_count") < least, "short_chunk"), F.when(F.col("contains_toc_like_content"), "toc_like_content"), F.when(F.col("contains_front_matter"), "front_matter_like")))
    out = kept(out.select(
        F.col("book").alias(key), F.col("chunk_no").cast("int").alias("chunk_no"), F.concat(F.lit("chunk_"), T.padded(F.col("chunk_no"), 3)).alias("chunk_id"), "text", "n_paragraphs", "word_count", "char_count", "start_offset",
        end.alias("end_offset"), (F.col("start_offset") + F.col("chunk_no")).alias("true_start"), "part_hint", "chapter_hint", "contains_toc_like_content", "contains_front_matter", warnings.alias("warnings"),
    ), "longbooks-records")
    dropped(own, entered, made)
    return out
