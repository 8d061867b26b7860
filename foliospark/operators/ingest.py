"""Raw text to lines, paragraphs and chunks.

A document is one row, and all of its cleaning, folding and chunking happens inside that row or, for cleaning, on Arrow arrays of many rows'
lines: no line or paragraph is shuffled. Only what is listed across documents' lines (repeated_lines) or rows made from the arrays is a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.functions import text as T
from foliospark.functions.text import let


def plain(c: Column) -> Column:
    return T.plain_breaks(T.plain_punctuation(c))


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table as it is read, dealt out by its key if it has fewer parts than the cluster has cores: a file of few row groups would else be few tasks' work.

    Texts are shuffled only then; a large table has parts enough. Cleaning costs far more than this shuffle.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, key) if docs.rdd.getNumPartitions() < cores else docs


def exploded(df: DataFrame, key: str, values: Column, place: str, value: str) -> DataFrame:
    """(key, place, value) of an array's elements. By the outer form, as Spark would filter for arrays that aren't empty before the plain one, and compute them twice for that."""
    return df.select(key, F.posexplode_outer(values).alias(place, value)).where(F.col(place).isNotNull())


def lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_no from 0, line, stripped) of every line, punctuation and line breaks in plain form."""
    return exploded(docs, key, F.split(plain(F.col(text_col)), "\n", -1), "line_no", "line").withColumn("stripped", T.strip(F.col("line")))


def may_repeat(s: Column) -> Column:
    """Whether a stripped line counts as a header or footer when it comes again: up to 120 characters, no chapter or part."""
    return (s != "") & (F.length(s) <= 120) & ~s.rlike(T.CHAPTER) & ~s.rlike(T.PART)


def repeated_lines(all_lines: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, stripped, cnt): lines of a document that occur `least` times or more, see may_repeat()."""
    s = F.col("stripped")
    return all_lines.groupBy(key, "stripped").agg(F.count("*").alias("cnt")).where((F.col("cnt") >= least) & may_repeat(s))


def folded(text: Column) -> Column:
    """array<struct<kind, text>> of a text's paragraphs: blank lines part them; headings, scene breaks and table-of-contents lines stand alone.

    Each line gets a letter for its kind and special ones empty lines around them, so that the text falls into paragraphs at empty lines.
    """

    def lettered(line):
        return let(T.strip(line), lambda s: F.when(s == "", s).when(T.stripped_heading(s), around("h", s)).when(s.rlike(T.SCENE_BREAK), around("s", s)).when(s.rlike(T.TOC_LEADER), around("c", s)).otherwise(F.concat(F.lit("t"), s)))

    around = lambda letter, s: F.concat(F.lit("\n" + letter), s, F.lit("\n"))
    parts = F.split(F.array_join(F.transform(F.split(text, "\n", -1), lettered), "\n"), "\n\n+")
    trimmed = F.filter(F.transform(parts, lambda p: F.trim(p, F.lit("\n"))), lambda p: p != "")
    names = F.create_map(*[F.lit(x) for kv in (("t", "text"), ("h", "heading"), ("s", "scene_break"), ("c", "toc")) for x in kv])
    joined = lambda p: let(F.replace(F.substring(p, 2, 2**31 - 1), F.lit("\nt"), F.lit(" ")), T.collapse)
    return F.transform(trimmed, lambda p: F.struct(F.element_at(names, F.left(p, F.lit(1))).alias("kind"), F.when(F.left(p, F.lit(1)) == "t", joined(p)).otherwise(F.substring(p, 2, 2**31 - 1)).alias("text")))


#: Bytes of text that a task cleans at once; a longer document goes alone.
CLEAN_BYTES = 8 << 20
CLEANED = "n_lines bigint, removed_page_markers bigint, removed_repeated_headers bigint, raw_char_count bigint, raw_word_count bigint, paras array<struct<kind:string,text:string>>"


def _matches(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _capitals(s: pa.Array) -> np.ndarray:
    """Up to 90 characters in capitals with a Latin capital among them; only what has no small ASCII letter is worth a look at case beyond ASCII."""
    out = (pc.utf8_length(s).to_numpy(zero_copy_only=False) <= 90) & _matches(s, "[A-Z]") & ~_matches(s, "[a-z]")
    for i in np.flatnonzero(out & ~pc.string_is_ascii(s).to_numpy(zero_copy_only=False)):
        line = s[i].as_py()
        out[i] = line == line.upper()
    return out


def _runs(of: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n lists whose elements, in order, have the list's numbers `of`."""
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)


def _lines_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(lines, stripped, number of the text) of texts without nulls."""
    lists = pc.split_pattern(texts, "\n")
    return lists.flatten(), pc.utf8_trim(lists.flatten(), characters=T.SPACES), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _kept_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(texts without page markers and repeated lines, lines, page markers, repeated lines) by text. A line is repeated if its text has three equal ones that may repeat."""
    n, (lines, s, of) = len(texts), _lines_of(texts)
    marker = _matches(s, T.PAGE_MARKER)
    codes = pc.dictionary_encode(s).indices.to_numpy(zero_copy_only=False)
    _, which, counts = np.unique(of.astype(np.int64) << 32 | codes, return_inverse=True, return_counts=True)
    often = np.flatnonzero((counts[which] >= 3) & ~marker)
    seen = s.take(pa.array(often))
    may = (pc.utf8_length(seen).to_numpy(zero_copy_only=False) <= 120) & _matches(seen, ".") & ~_matches(seen, T.CHAPTER) & ~_matches(seen, T.PART) & ~_capitals(seen)
    repeated = np.zeros(len(s), bool)
    repeated[often[may]] = True
    stays = ~(marker | repeated)
    held = pa.ListArray.from_arrays(pa.array(_runs(of[stays], n)), lines.filter(pa.array(stays)))
    count = lambda where: np.bincount(of[where], minlength=n)
    return pc.binary_join(held, "\n"), np.bincount(of, minlength=n), count(marker), count(repeated)


def _paragraphs(texts: pa.Array) -> pa.Array:
    """folded() of texts without nulls."""
    n, (_, s, of) = len(texts), _lines_of(texts)
    heading = _capitals(s) | _matches(s, T.CHAPTER) | _matches(s, T.PART)
    scene, toc = _matches(s, T.SCENE_BREAK), _matches(s, T.TOC_LEADER)
    alone = heading | scene | toc
    blank = pc.equal(s, "").to_numpy(zero_copy_only=False)
    opens = alone | np.concatenate([[True], (alone | blank)[:-1] | (of[1:] != of[:-1])])[: len(s)]
    there = np.flatnonzero(~blank)
    first = there[opens[there]]
    # A line that isn't blank belongs to the paragraph that opened last.
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(opens[there]), len(there)).astype(np.int32)), s.take(pa.array(there))), " ")
    kinds = np.where(heading, "heading", np.where(scene, "scene_break", np.where(toc, "toc", "text")))[first]
    plain_ = pc.utf8_trim(pc.replace_substring_regex(raw, rf"{T.WS}+", " "), characters=" ")
    text = pc.if_else(pa.array(alone[first]), raw, plain_)
    return pa.ListArray.from_arrays(pa.array(_runs(of[first], n)), pa.StructArray.from_arrays([pa.array(kinds, pa.string()), text], ["kind", "text"]))


def _cleaned(texts: pa.Array) -> list[pa.Array]:
    """The columns CLEANED of texts."""
    held, lines, markers, repeated = _kept_lines(there := texts.drop_null())
    joined = pc.replace_substring_regex(held, "([A-Za-z])-\n([a-z])", r"\1\2")
    numbers = [pa.array(x, pa.int64()) for x in (lines, markers, repeated)]
    numbers += [c.cast(pa.int64()) for c in (pc.utf8_length(there), pc.count_substring_regex(there, T.WORD))]
    # Where a text is null, so is all else.
    place = pc.if_else(texts.is_valid(), pc.subtract(pc.cumulative_sum(texts.is_valid().cast(pa.int64())), 1), None)
    return [c.take(place) for c in (*numbers, _paragraphs(joined))]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of up to CLEAN_BYTES, a text at least."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, CLEAN_BYTES + (ends[start - 1] if start else 0), "right")))
        yield start, stop - start
        start = stop


def cleaned(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_lines, removed_page_markers, removed_repeated_headers, raw_char_count, raw_word_count, paras, clean_text).

    Page markers and repeated headers go, hyphens at line ends are rejoined, lines are folded into paragraphs; raw counts are those of the
    text in plain form. A null text has null counts and no paragraphs. The rules run on Arrow arrays of many documents' lines at once, as
    lambdas over arrays would take each line by itself; documents stay where they are.
    """
    own = docs.select(key, plain(F.make_valid_utf8(F.col(text_col))).alias("_t"))
    schema = f"`{key}` {own.schema[key].dataType.simpleString()}, {CLEANED}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n in _pieces(b.column(1)):
                columns = [b.column(0), *_cleaned(b.column(1).slice(start, n).cast(pa.string()))]
                yield pa.RecordBatch.from_arrays([(columns[0].slice(start, n)).cast(arrow[0].type), *[c.cast(f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True)]], schema=arrow)

    text = F.concat(F.array_join(F.transform("paras", lambda p: p["text"]), "\n\n"), F.lit("\n"))
    return own.mapInArrow(run, schema).withColumn("clean_text", text)


def clean_stats(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cleaned() with clean_char_count and clean_word_count in place of the texts."""
    got = cleaned(docs, key, text_col)
    return got.withColumn("clean_char_count", F.length("clean_text").cast("bigint")).withColumn("clean_word_count", T.word_count(F.col("clean_text"))).drop("paras", "clean_text")


def paragraph_rows(held: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, para_no, kind, text) from (key, paras)."""
    return exploded(held, key, F.col("paras"), "para_no", "_p").select(key, "para_no", "_p.kind", "_p.text")


def paragraphs(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, para_no, kind, text) of the texts as they are; for filtered ones take cleaned()."""
    return paragraph_rows(docs.select(key, folded(plain(F.col(text_col))).alias("paras")), key)


def clean_paragraphs(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines filtered, hyphens at line ends rejoined, folded into paragraphs."""
    return paragraph_rows(cleaned(docs, key, text_col), key)


def gathered(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paras) from rows (key, para_no, text): one shuffle, for paragraphs that come from elsewhere."""
    rows = F.array_sort(F.collect_list(F.struct("para_no", F.lit("text").alias("kind"), "text")))
    return paras.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"))).alias("paras"))


def structure_hints(held: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parts, chapters, scene_breaks) from (key, paras): each distinct one in the order of its first appearance; a part goes before a chapter, a chapter before a scene break."""
    texts = F.transform("paras", lambda p: T.strip(p["text"]))
    part, chapter, scene = (lambda t: t.rlike(T.PART)), (lambda t: t.rlike(T.CHAPTER)), (lambda t: t.rlike(T.SCENE_BREAK))
    return held.select(
        key,
        F.array_distinct(F.filter(texts, part)).alias("parts"),
        F.array_distinct(F.filter(texts, lambda t: chapter(t) & ~part(t))).alias("chapters"),
        F.array_distinct(F.filter(texts, lambda t: scene(t) & ~part(t) & ~chapter(t))).alias("scene_breaks"),
    )


CUT = "array<struct<start:int,size:int,words:bigint,chars:bigint,part:int,chapter:int,upto:bigint>>"


def _cuts(facts: Column, least: int, target: int, most: int) -> Column:
    """The chunks (CUT) that a greedy walk over a text's paragraph facts closes; the walk keeps the open chunk and the last part and chapter.

    A chunk takes the part that is known when it is closed: a part that opens the next chunk counts if it is what closes this one.
    """
    zero = F.expr(f"named_struct('at', 0, 'start', 0, 'words', 0L, 'chars', 0L, 'upto', 0L, 'part', -1, 'chapter', -1, 'out', CAST(array() AS {CUT}))")

    def closed(acc, end, words, chars, part, chapter):
        return F.struct(acc["start"].alias("start"), (end - acc["start"]).alias("size"), words.alias("words"), chars.alias("chars"), part.alias("part"), chapter.alias("chapter"), acc["upto"].alias("upto"))

    def step(acc, p):
        part = F.when(p["part"], acc["at"]).otherwise(acc["part"])
        filled = acc["at"] > acc["start"]
        before = filled & F.when(p["chapter"], acc["words"] >= least).when(p["scene"], acc["words"] >= target).otherwise(acc["words"] + p["w"] > most)
        first = F.when(before, F.array_append(acc["out"], closed(acc, acc["at"], acc["words"], acc["chars"], part, acc["chapter"]))).otherwise(acc["out"])
        opened = F.struct(
            (acc["at"] + 1).alias("at"), F.when(before, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(before, p["w"]).otherwise(acc["words"] + p["w"]).alias("words"), F.when(before, p["c"]).otherwise(acc["chars"] + p["c"]).alias("chars"),
            (acc["upto"] + p["c"]).alias("upto"), part.alias("part"), F.when(p["chapter"], acc["at"]).otherwise(acc["chapter"]).alias("chapter"), first.alias("out"),
        )
        return let(opened, lambda a: after(a, ~p["chapter"] & ~p["scene"] & p["ends"] & (a["words"] >= target)))

    def after(a, full):
        done = F.array_append(a["out"], closed(a, a["at"], a["words"], a["chars"], a["part"], a["chapter"]))
        zeroed = F.struct(a["at"].alias("at"), a["at"].alias("start"), F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("chars"), a["upto"].alias("upto"), a["part"].alias("part"), a["chapter"].alias("chapter"), done.alias("out"))
        return F.when(full, zeroed).otherwise(a)

    def flushed(a):
        rest = closed(a, a["at"], a["words"], a["chars"], a["part"], a["chapter"])
        return F.when(a["at"] > a["start"], F.array_append(a["out"], rest)).otherwise(a["out"])

    return F.aggregate(facts, zero, step, flushed)


def chunk_records(held: DataFrame, key: str = "doc_id", least: int = 1200, target: int = 1800, most: int = 2200) -> DataFrame:
    """A row per chunk of (key, paras): (key, chunk_no, chunk_id, text, n_paragraphs, word_count, char_count, start_offset, end_offset,
    true_start, part_hint, chapter_hint, contains_toc_like_content, contains_front_matter, warnings).

    Offsets add up the chunks' lengths; true_start is the chunk's place in the clean text, which has one line break more between chunks.
    """
    if not least <= target <= most:
        raise ValueError("least <= target <= most is needed")

    def fact(p):
        t = p["text"]
        chapter = t.rlike(T.CHAPTER)
        ends = F.right(t, F.lit(1)).isin(".", '"', "'") | T.stripped_heading(t)
        return F.struct(T.word_count(t).alias("w"), F.length(t).cast("bigint").alias("c"), chapter.alias("chapter"), t.rlike(T.PART).alias("part"), t.rlike(T.SCENE_BREAK).alias("scene"), ends.alias("ends"))

    def made(c, paras, no):
        texts = F.transform(F.slice(paras, c["start"] + 1, c["size"]), lambda p: p["text"])
        hint = lambda i: F.when(i >= 0, F.get(paras, i)["text"])
        # Up to a chunk's end there are `upto` characters, two line breaks between the paragraphs of a chunk and one after it.
        end = c["upto"] + 2 * (c["start"] + c["size"]) - no - 1
        size = c["chars"] + 2 * (c["size"] - 1) + 1
        return let(texts, lambda t: F.struct(
            F.concat(F.array_join(t, "\n\n"), F.lit("\n")).alias("text"), c["size"].alias("n_paragraphs"), c["words"].alias("word_count"), size.alias("char_count"), (end - size).alias("start_offset"), end.alias("end_offset"),
            (end - size + no).alias("true_start"), hint(c["part"]).alias("part_hint"), hint(c["chapter"]).alias("chapter_hint"), F.exists(t, T.is_toc_like).alias("contains_toc_like_content"), F.exists(t, T.is_front_matter).alias("contains_front_matter"),
        ))

    # A chunk's struct holds its own paragraphs only, so that exploding doesn't copy the book into each chunk.
    each = exploded(held, key, let(F.col("paras"), lambda paras: F.transform(_cuts(F.transform(paras, fact), least, target, most), lambda c, no: made(c, paras, no))), "chunk_no", "_c")
    rows = each.select(key, "chunk_no", F.concat(F.lit("chunk_"), T.padded(F.col("chunk_no"), 3)).alias("chunk_id"), "_c.*")
    warnings = F.array_compact(F.array(F.when(F.col("word_count") < least, "short_chunk"), F.when(F.col("contains_toc_like_content"), "toc_like_content"), F.when(F.col("contains_front_matter"), "front_matter_like")))
    return rows.withColumn("warnings", warnings)


def chunked(paras: DataFrame, key: str = "doc_id", least: int = 1200, target: int = 1800, most: int = 2200) -> DataFrame:
    """(key, chunk_no, para_no): which chunk each of the paragraphs (key, para_no, text) goes to."""
    if not least <= target <= most:
        raise ValueError("least <= target <= most is needed")
    got = chunk_records(gathered(paras, key), key, least, target, most).select(key, "chunk_no", "n_paragraphs")
    ends = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "n_paragraphs"))).alias("c"))
    numbers = F.flatten(F.transform("c", lambda r: F.array_repeat(r["chunk_no"], r["n_paragraphs"])))
    return ends.select(key, F.posexplode(numbers).alias("para_no", "chunk_no")).select(key, "chunk_no", "para_no")


def chunk_stats(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_count, total_chunk_words, avg_chunk_words) of chunk_records()."""
    n, words = F.count("*"), F.sum("word_count")
    return records.groupBy(key).agg(n.alias("chunk_count"), words.alias("total_chunk_words"), T.rounded(words / n, 2).alias("avg_chunk_words"))


def fixed_chunks(docs: DataFrame, size: int = 2000, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, chunk_no, n_words): cuts after every `size` words."""
    n = T.word_count(F.col(text_col))
    rows = docs.select(key, n.alias("n")).where("n > 0")
    cuts = rows.select(key, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))).alias("chunk_no"))
    return cuts.select(key, "chunk_no", F.least(F.lit(size).cast("bigint"), F.col("n") - F.col("chunk_no") * size).alias("n_words"))


def plain_lines(docs: DataFrame, title: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text): the older cleaner. Blank lines, lines of digits, the title's own line and lines with fewer than three letters go."""
    s = T.strip
    letters = lambda x: F.length(F.regexp_replace(x, "[^a-zA-Z]", "")) >= 3
    kept = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), s), lambda x: (x != "") & ~x.rlike("^[0-9]+$") & (F.lower(x) != title.lower()) & letters(x))
    return docs.select(key, F.array_join(kept, "\n").alias("text"))
