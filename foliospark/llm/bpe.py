"""Byte-level BPE: encoding and decoding by a public rank table.

Method: the pretokens of a batch that are not known yet are dealt into buckets by length, each bucket is one padded
matrix of ids, and every round each row merges its leftmost pair of minimum rank; pair ranks come from an open-addressed
hash table held in two arrays, and rows are compacted after each merge. A pretoken's ids depend on nothing else, so a
worker keeps them in a bounded memo.

A pretoken longer than LONG bytes would cost the matrix form a square of its length, so such rows merge by a heap over a
linked list, which picks the same pair each round. Null text counts as empty: no tokens, the hash of the empty string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliospark.llm.common import MEMO, slices

NONE = np.int32(2**31 - 1)
LONG = 1024
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """Token bytes by id, and the rank of each mergeable pair of ids in a hash table probed by numpy."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(tokens.values()) + 1
        self.tokens = [b""] * size
        for t, i in tokens.items():
            self.tokens[i] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.tokens_id = tokens
        # Every way to cut a token into two tokens is a pair that merges into it.
        pairs = {(tokens[t[:k]] << 32) | tokens[t[k:]]: i for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        left_k, left_v = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(left_k)
        while len(left_k):
            empty = self.keys[slot] == -1
            self.keys[slot[empty]], self.vals[slot[empty]] = left_k[empty], left_v[empty]
            lost = self.keys[slot] != left_k  # taken before, or by another key of this round
            left_k, left_v, slot = left_k[lost], left_v[lost], (slot[lost] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair (a, b); NONE where they don't merge or either is padding (-1)."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        out, todo = np.full(key.shape, NONE, np.int32), np.flatnonzero((a >= 0) & (b >= 0))
        flat, key = out.reshape(-1), key.reshape(-1)
        slot = self._slot(key[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            flat[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (held != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def _merge_matrix(r: Ranks, rows: list[bytes]) -> list[np.ndarray]:
    """The ids of each row; rows are of similar length."""
    n, width = len(rows), max(map(len, rows))
    ids = np.full((n, width), -1, np.int32)
    size = np.array([len(x) for x in rows])
    held = np.arange(width)[None, :] < size[:, None]
    ids[held] = r.byte[np.frombuffer(b"".join(rows), np.uint8)]
    ranks = np.full((n, width), NONE, np.int32)
    ranks[:, :-1] = r.rank(ids[:, :-1], ids[:, 1:])
    out: list = [None] * n
    live = np.arange(n)
    cols = np.arange(width)
    while len(live):
        at = ranks.argmin(axis=1)  # the first of equals: leftmost
        row = np.arange(len(live))
        best = ranks[row, at]
        done = best == NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[live[i]] = ids[i, : size[i]].copy()
            keep = ~done
            live, ids, ranks, size, at, best = live[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
            if not len(live):
                break
            width = int(size.max())
            ids, ranks, cols = ids[:, :width], ranks[:, :width], cols[:width]
            row = np.arange(len(live))
        ids[row, at] = best
        # Compaction: what stands right of the merged pair moves one to the left.
        src = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
        ids, ranks = np.take_along_axis(ids, src, 1), np.take_along_axis(ranks, src, 1)
        size = size - 1
        ids[row, size], ranks[row, size] = -1, NONE
        ranks[row, at] = r.rank(ids[row, at], np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1))
        left = at > 0
        ranks[row[left], at[left] - 1] = r.rank(ids[row[left], at[left] - 1], ids[row[left], at[left]])
    return out


def _merge_long(r: Ranks, row: bytes) -> np.ndarray:
    ids = r.byte[np.frombuffer(row, np.uint8)]
    first = r.rank(ids[:-1], ids[1:])
    ids, n = ids.tolist(), len(ids)
    prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    toks, known = r.tokens, r.tokens_id
    heap = [(k, i, ids[i], ids[i + 1]) for i, k in enumerate(first.tolist()) if k != NONE]
    heapq.heapify(heap)
    while heap:
        k, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = k, False, after[j]
        if after[j] >= 0:
            prev[after[j]] = i
        for x in (prev[i], i):
            y = after[x] if x >= 0 else -1
            if y >= 0 and (t := known.get(toks[ids[x]] + toks[ids[y]])) is not None:
                heapq.heappush(heap, (t, x, ids[x], ids[y]))
    return np.array([t for t, ok in zip(ids, alive, strict=True) if ok], np.int32)


def encode_words(r: Ranks, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each pretoken."""
    out: list = [None] * len(words)
    buckets: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if (whole := r.tokens_id.get(w)) is not None:
            out[i] = np.array([whole], np.int32)
        elif not w:
            out[i] = np.zeros(0, np.int32)
        elif len(w) > LONG:
            out[i] = _merge_long(r, w)
        else:
            buckets.setdefault(-(-len(w) // 4) if len(w) <= 32 else 64 + len(w).bit_length(), []).append(i)
    for rows in buckets.values():
        step = max(1, 2_000_000 // max(len(words[i]) for i in rows))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            for i, ids in zip(part, _merge_matrix(r, [words[i] for i in part]), strict=True):
                out[i] = ids
    return out


class Coder:
    """Texts to ids and back, with a memo of pretokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = load(path), regex.compile(pattern).findall
        self.known: dict[str, tuple[np.ndarray, bytes]] = {}

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text its ids, and them in decimal joined by commas."""
        if len(self.known) > MEMO:
            self.known.clear()
        words = [self.find(t) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.known))
        for w, ids in zip(new, encode_words(self.ranks, [w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            self.known[w] = (ids, ",".join(map(str, ids.tolist())))
        for ws in words:
            got = [self.known[w] for w in ws]
            yield (np.concatenate([x[0] for x in got]) if got else np.zeros(0, np.int32)), ",".join([x[1] for x in got])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, gathered from the flat table of token bytes."""
        r, n = self.ranks, self.ranks.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return r.flat[np.repeat(r.starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text. keep_ids: also return the ids themselves."""

    def run(batches):
        coder = Coder(path, pattern)
        for b in slices(batches, 128):
            n, ids_hash, text_hash, lists = [], [], [], []
            for ids, decimal in coder.encode(b.column(1).to_pylist()):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(decimal.encode()).hexdigest())
                text_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if keep_ids:
                    lists.append(ids)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
