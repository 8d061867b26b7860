"""Quality classifier: supervised subword embeddings.

A document's vector is the mean of the learned vectors of its features: hashed words, hashed pairs of neighbouring words
and hashed character n-grams of each word; a softmax layer gives the classes. All is trained by numpy stochastic gradient
descent on a bounded sample of labelled rows (`limit`). Because the output layer is linear in the mean, a trained model
also gives each feature one value, the difference of its two logits, and scoring averages those: the same score, without
the vectors.

Null, empty and blank texts have no features: their score is that of the output bias alone. A pair of equal neighbours is one feature for all words,
so that repetition is learned as such.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.common import MEMO, Csr, Grams, Memo, slices, spread

SCHEMA = "doc_id bigint, score double, predicted int"
NGRAMS = (3, 4)
MIX = 0x9E3779B97F4A7C15


class Words:
    """word -> row of its features (itself and its character n-grams), its hash for pairs; with values, its row's sum."""

    def __init__(self, buckets: int, values: np.ndarray | None = None):
        self.buckets, self.values = buckets, values
        self.grams = Grams(NGRAMS, buckets)
        self.clear()

    def clear(self) -> None:
        self.memo, self.rows = Memo(self._new), Csr()
        self.sums, self.counts, self.hashes = np.zeros(0), array("q"), array("Q")

    def _new(self, word: str) -> int:
        w = word.encode("utf-8", "surrogatepass")
        row = [zlib.crc32(b"w" + w) % self.buckets, *self.grams(word)]
        self.counts.append(len(row))
        self.hashes.append(zlib.crc32(w, 77))
        return len(self.sums) + self.rows.add(row)

    def pairs(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each pair of neighbours within a document, and its document."""
        if len(ids) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        same = doc[1:] == doc[:-1]
        a, b = ids[:-1][same], ids[1:][same]
        h = np.array(self.hashes, np.uint64)
        with np.errstate(over="ignore"):
            key = ((h[a] * np.uint64(MIX) + h[b]) * np.uint64(MIX)) >> np.uint64(20)
        return np.where(a == b, 0, key % np.uint64(self.buckets)).astype(np.int64), doc[1:][same]

    def ids(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if self.values is not None and len(self.memo) > MEMO:
            self.clear()
        self.grams.memo.trim()
        lists = [(t or "").split() for t in texts]
        flat = np.fromiter((self.memo[w] for ws in lists for w in ws), np.int64, sum(map(len, lists)))
        if self.values is not None:
            self.sums = np.concatenate([self.sums, self.rows.row_sums(self.values)])
            self.rows = Csr()
        return flat, np.repeat(np.arange(len(texts)), [len(ws) for ws in lists])


class Model:
    """values: the difference of the two logits of each feature; bias: that of the output layer."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias


def train(texts: list, labels: list, buckets: int = 1 << 18, dim: int = 8, epochs: int = 4, least_steps: int = 700, rate: float = 0.5, batch: int = 16, seed: int = 11) -> Model:
    """Vectors E and output layer O by SGD on the softmax's log loss. Small samples are passed over more often, for `least_steps`
    at least. With no or one class: the smoothed class rate for all."""
    labels = np.array(labels, np.int64)
    if not len(texts) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    words = Words(buckets)
    bags = []
    for a in range(0, len(texts), 64):
        ids, doc = words.ids(texts[a : a + 64])
        pair, pair_doc = words.pairs(ids, doc)
        held = words.rows.arrays()
        for d in range(len(texts[a : a + 64])):
            flat, start, size = held
            f, c = np.unique(np.concatenate([flat[spread(ids[doc == d], start, size)[0]], pair[pair_doc == d]]), return_counts=True)
            if len(f):
                bags.append((f.astype(np.int32), (c / c.sum()).astype(np.float32), int(labels[a + d])))
    a_pass = max(1, -(-len(bags) // batch))
    epochs = max(epochs, -(-least_steps // a_pass)) if bags else 0
    steps, done = epochs * a_pass, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            part = [bags[i] for i in order[a : a + batch]]
            f, c = np.concatenate([x for x, _, _ in part]), np.concatenate([x for _, x, _ in part])
            start = np.cumsum([0, *[len(x) for x, _, _ in part[:-1]]])
            y = np.array([v for *_, v in part])
            doc = np.repeat(np.arange(len(part)), [len(x) for x, _, _ in part])
            mean = np.add.reduceat(e[f] * c[:, None], start, axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            lr = rate * (1 - done / steps)
            back = p @ out.T
            out -= lr * (mean.T @ p) / len(part) * 4
            bias -= lr * p.mean(0)
            np.subtract.at(e, f, lr * back[doc] * c[:, None] * 4)
            done += 1
    return Model((e @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: score of class 1 and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        words = Words(len(m.values), m.values)
        for b in slices(batches):
            n = b.num_rows
            ids, doc = words.ids(b.column(1).to_pylist())
            pair, pair_doc = words.pairs(ids, doc)
            total = np.bincount(doc, words.sums[ids], n) + np.bincount(pair_doc, m.values[pair], n)
            count = np.bincount(doc, np.array(words.counts, float)[ids], n) + np.bincount(pair_doc, minlength=n)
            z = total / np.maximum(count, 1) + m.bias
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
