"""Removal of passages that a document shares with a document of smaller id, by suffix automata of the repeated passages.

A window is `width` consecutive words of one document; words are runs of bytes other than space and \\t \\n \\v \\f \\r. Every
word that is covered by a window whose word sequence also starts in a document with a smaller doc_id is removed.

1. References. Of the K-word hashes inside each window the least is its anchor, so equal windows have equal anchors. Windows
   with an anchor that two documents hold are hashed as a whole (64 bits); an aggregate that combines before the shuffle
   finds, for each hash seen in two documents, the first of them. Those windows of their first documents are the
   reference passages: each repeated window once.
2. Shards. A passage belongs to the shard that its document's hash and its level name; the level rises with the number of
   documents that hold the window. The number of shards grows with the references, so that one holds about SHARD words.
   A shard goes to 2**level tasks, so that a passage in a third of all documents is split over many, and each task has
   about HOLDERS documents for a window.
3. Matching statistics. Each task builds the suffix automaton of its shard, over words and not hashes, and streams whole
   documents past it: only those that a window hash routes there. Where 50 words or more match, a state tells the
   smallest document with the last 50 of them. Maximal spans of such words go back to the documents.

A shard goes only to the tasks whose documents can match it and not to all: the references of a corpus have no size bound.

Null text: no words. Documents of a null id are kept whole and remove nothing elsewhere. Rows that repeat a doc_id are
one document in the comparison with others, and none of them removes words from another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import MEMO, Memo, cut, drop, slices

WIDTH, ANCHOR = 50, 16
#: Words of references in a shard, and documents that hold a window for each task of its shard.
SHARD, HOLDERS = 50_000, 64
BASE = 0x9E3779B97F4A7C17
INVERSE = pow(BASE, -1, 1 << 64)
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Hasher:
    """Hashes of all k-word windows of a text."""

    def __init__(self):
        self.memo = Memo(xxhash.xxh64_intdigest)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            size = max(n, 2 * len(self.power), 4096)
            self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE))

    def sums(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        n = len(words)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(self.memo.__getitem__, words), np.uint64, n) * self.power[:n], dtype=np.uint64, out=out[1:])
        return out

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        if len(sums) <= k:
            return np.zeros(0, np.uint64)
        h = (sums[k:] - sums[:-k]) * self.inverse[: len(sums) - k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors_at(grams: np.ndarray, span: int, rows: int = 1 << 16) -> np.ndarray:
    """The index of the least value, leftmost of equals, of every span consecutive values; each index once."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    view = sliding_window_view(grams, span)
    return np.unique(np.concatenate([view[a : a + rows].argmin(1) + np.arange(a, min(a + rows, len(view))) for a in range(0, len(view), rows)]))


def runs(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of the words that windows at the sorted starts cover, where starts in a run are consecutive."""
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.r_[0, edge + 1]].tolist(), (at[np.r_[edge, len(at) - 1]] + width).tolist(), strict=True))


class Automaton:
    """Suffix automaton of word sequences. After close(), `first[state]` is the smallest document with the last `width` words of the state's strings."""

    def __init__(self, width: int):
        self.width, self.ids, self.last, self.ends = width, {}, 0, 0
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [np.iinfo(np.int64).max]
        self.open = True

    def _extend(self, word: int, doc: int) -> None:
        step, link, size = self.next, self.link, self.size
        p, new = self.last, len(size)
        step.append({})
        size.append(size[p] + 1)
        self.first.append(doc)
        link.append(0)
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[q] > size[p] + 1:
                clone = len(size)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                self.first.append(self.first[q])
                link.append(link[q])
                link[q] = clone
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                q = clone
            link[new] = q
        self.last = new

    def add(self, doc: int, words: list[bytes]) -> None:
        for w in words:
            self._extend(self.ids.setdefault(w, len(self.ids)), doc)
        self.ends += 1  # a sign that no document has keeps the sequences apart
        self._extend(-self.ends, doc)

    def close(self) -> None:
        order = np.argsort(np.array(self.size), kind="stable").tolist()
        link, size, first, width = self.link, self.size, self.first, self.width
        for v in reversed(order[1:]):
            if first[v] < first[link[v]]:
                first[link[v]] = first[v]
        for v in order[1:]:
            if size[link[v]] >= width:
                first[v] = first[link[v]]
        self.open = False

    def starts(self, words: list[bytes], doc: int) -> np.ndarray:
        """Starts of the windows of words that a document smaller than doc holds too."""
        step, link, size, first, width = self.next, self.link, self.size, self.first, self.width
        at, length, out = 0, 0, []
        for i, word in enumerate(map(self.ids.get, words)):
            if word is None:
                at = length = 0
                continue
            to = step[at].get(word)
            if to is None:
                while at >= 0 and word not in step[at]:
                    at = link[at]
                if at < 0:
                    at = length = 0
                    continue
                length, at = size[at] + 1, step[at][word]
            else:
                length, at = length + 1, to
            if length >= width and first[at] < doc:
                out.append(i - width + 1)
        return np.array(out, np.int64)


def _pairs(batches, make, name: str):
    """(hash, doc_id) of make(text, extra column)'s distinct hashes."""
    for b in slices(batches, 128):
        docs, hashes = [], []
        extra = b.column(2) if b.num_columns > 2 else None
        for i, (d, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            h = np.unique(make(text, None if extra is None else extra[i]))
            hashes.append(h.view(np.int64))
            docs.append(np.full(len(h), d, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(docs))], [name, "doc_id"])


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    """Of the keys that two documents at least hold: the smallest document and the number of holders."""
    held = rows.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("holders"))
    return held.where("first < last").select(F.col(key).alias("_key"), "first", "holders")


def routes(own: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """(_of, refs, to): for each doc_id the windows (hash, shard, level) that it is the first to hold, and the (shard, level) of those that an earlier one holds. own: (doc_id, text)."""

    def anchors(batches):
        h = Hasher()

        def make(text, _):
            words = words_of(text)
            if len(words) < width:
                return np.zeros(0, np.uint64)
            g = h.windows(h.sums(words), k)
            return g[anchors_at(g, width - k + 1)]

        return _pairs(batches, make, "f")

    def windows(batches):
        h = Hasher()

        def make(text, shared):
            words = words_of(text)
            if len(words) < width:
                return np.zeros(0, np.uint64)
            sums = h.sums(words)
            hit = np.isin(h.windows(sums, k), shared.values.to_numpy().view(np.uint64))
            # A window holds an anchor if one of its k-word hashes is shared.
            inside = np.cumsum(np.r_[0, hit])
            return h.windows(sums, width)[inside[width - k + 1 :] > inside[: -(width - k + 1)]]

        return _pairs(batches, make, "w")

    known = own.where("doc_id IS NOT NULL")
    a = cut(known.mapInArrow(anchors, "f bigint, doc_id bigint"), "anchors")
    shared = a.join(_firsts(a, "f"), F.col("f") == F.col("_key")).groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list("f").alias("shared"))
    shared = cut(shared, "shared")
    drop(a)
    asked = known.join(shared, F.col("doc_id") == F.col("_of")).select("doc_id", "text", "shared")
    w = cut(asked.mapInArrow(windows, "w bigint, doc_id bigint"), "windows")
    drop(shared)
    held = cut(_firsts(w, "w"), "firsts")
    shards = max(1, -(-held.count() // SHARD))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("holders") / HOLDERS))).cast("int")
    firsts = held.select("_key", "first", F.pmod(F.xxhash64("first"), F.lit(shards)).alias("shard"), level.alias("level"))
    refs = firsts.groupBy("first").agg(F.collect_list(F.struct("_key", "shard", "level")).alias("refs"))
    to = w.join(firsts, F.col("w") == F.col("_key")).where("doc_id > first").select("doc_id", "shard", "level").distinct()
    to = to.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "level")).alias("to"))
    both = refs.join(to, F.col("first") == F.col("doc_id"), "full")
    out = cut(both.select(F.coalesce("first", "doc_id").alias("_of"), "refs", "to"), "routes")
    drop(w, held)
    return out


def spans(own: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """(_of, _key, _spans): for each document with words to remove its id, the hash of its text, and starts and ends by turns. own: (doc_id, text)."""

    def deal(batches):
        h = Hasher()
        for b in slices(batches, 128):
            rows = []
            for doc, text, key, refs, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                if refs.is_valid:
                    words = words_of(text)
                    hashes, shard, level = (c.to_numpy() for c in refs.values.flatten())
                    by = np.argsort(hashes.view(np.uint64))
                    known = hashes.view(np.uint64)[by]
                    found = h.windows(h.sums(words), width)
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    at = np.flatnonzero(known[place] == found)
                    of = level[by][place[at]]
                    for x in np.unique(of).tolist():
                        parts = [b" ".join(words[s:e]) for s, e in runs(at[of == x], width)]
                        rows.append((int(shard[0]), x, 0, doc, key, b"\n".join(parts)))
                rows.extend((t["shard"], t["level"], 1, doc, key, (text or "").encode("utf-8", "surrogatepass")) for t in to or ())
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "level", "kind", "doc_id", "key", "text"])

    def match(batches):
        task, automaton = None, Automaton(width)
        for b in slices(batches, 128):
            rows = []
            for shard, level, salt, kind, doc, key, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if task != (shard, level, salt):
                    task, automaton = (shard, level, salt), Automaton(width)
                if kind == 0:
                    for passage in text.split(b"\n"):
                        automaton.add(doc, passage.split())
                    continue
                if automaton.open:
                    automaton.close()
                found = runs(automaton.starts(text.split(), doc), width)
                if found:
                    rows.append((doc, key, [x for pair in found for x in pair]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["_of", "_key", "_spans"])

    marks = routes(own, width, k)
    asked = own.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("_of")).select("doc_id", "text", F.xxhash64("text").alias("key"), "refs", "to")
    dealt = asked.mapInArrow(deal, "shard bigint, level int, kind int, doc_id bigint, key bigint, text binary")
    salts = F.expr("shiftleft(1, level)")
    salt = F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), salts).cast("int"))))
    dealt = dealt.select("shard", "level", salt.alias("salt"), "kind", "doc_id", "key", "text")
    ordered = dealt.repartition("shard", "level", "salt").sortWithinPartitions("shard", "level", "salt", "kind", "doc_id")
    found = ordered.mapInArrow(match, "_of bigint, _key bigint, _spans array<bigint>")
    out = cut(found.groupBy("_of", "_key").agg(F.flatten(F.collect_list("_spans")).alias("_spans")), "spans")
    drop(marks)
    return out


def _marked(docs: DataFrame, width: int, k: int, id_col: str, text_col: str, make, schema: str, keep: tuple = ()) -> DataFrame:
    wide = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"_kept_{c}") for c in keep])
    bad = spans(wide.select("doc_id", "text"), width, k)
    joined = wide.join(bad, (wide["doc_id"] == bad["_of"]) & (F.xxhash64(wide["text"]) == bad["_key"]), "left").select("doc_id", "text", "_spans", *[f"_kept_{c}" for c in keep])

    def run(batches):
        for b in slices(batches, 128):
            rows = []
            for text, marked in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                gone = np.zeros(len(words), bool)
                for s, e in zip((marked or [])[::2], (marked or [])[1::2], strict=True):
                    gone[s:e] = True
                rows.append(make(text, words, gone))
            names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
            made = [pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[3:]], ["doc_id", *names, *b.schema.names[3:]])

    extra = "".join(f", `_kept_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(run, f"doc_id bigint, {schema}{extra}")


def digest(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words joined by one space, for each row."""

    def make(_, words, gone):
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    return _marked(docs, width, k, id_col, text_col, make, "n_words bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, text without the removed words (a text that loses nothing is unchanged, else its kept words are joined by one space), n_removed, and the columns in keep as _kept_<name>."""

    def make(text, words, gone):
        if not gone.any():
            return text, 0
        return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass"), int(gone.sum())

    return _marked(docs, width, k, id_col, text_col, make, "text string, n_removed bigint", keep)
