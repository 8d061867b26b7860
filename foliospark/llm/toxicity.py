"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words and their
character 5-grams, a document's score the noisy-or of its sentences: 1 - prod(1 - p_s). Only document labels are used; their gradient flows through the
noisy-or to the sentences, so the trained sentence scores also say where the offence is.

Sentences end at . ! ? and line breaks. Null and empty texts, and texts without a word, have no sentences and score 0.
Training takes a bounded sample of labelled rows (`limit`); a feature counts if it occurs in `min_df` sampled documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import MEMO, Csr, Grams, Memo, bounded_sample, slices, spread

BREAK = "\x01"
NGRAMS = (5,)
SCHEMA = "doc_id bigint, score double, predicted int, n_sentences int, worst_sentence int, worst_score double"


class Model:
    """Weights of hashed words and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def word_key(token: str) -> tuple[str, bool]:
    """A token without its outer punctuation, and whether it ends a sentence."""
    return token.strip(".,!?;:\"'()[]*#%&$|"), token == BREAK or token[-1] in ".!?"


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().replace("\n", f" {BREAK} ").split()


class Words:
    """Token -> row of features and sentence end, in growing arrays addressed by a memo. With weights a token's row is kept as its sum."""

    def __init__(self, buckets: int, weights: np.ndarray | None = None):
        self.buckets, self.weights = buckets, weights
        self.grams = Grams(NGRAMS, buckets)
        self.clear()

    def clear(self) -> None:
        self.rows, self.ends, self.memo = Csr(), [], Memo(self._new)
        self.sums = np.zeros(0)

    def _new(self, token: str) -> int:
        word, end = word_key(token)
        self.ends.append(end)
        return len(self.sums) + self.rows.add([zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % self.buckets, *self.grams(word)] if word and token != BREAK else [])

    def bags(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tokens that are words, the sentence of each, the document of each sentence. Empty sentences are left out."""
        if self.weights is not None and len(self.memo) > MEMO:
            self.clear()
        self.grams.memo.trim()
        lists = [tokens_of(t) for t in texts]
        ids = np.fromiter((self.memo[t] for ts in lists for t in ts), np.int64, sum(map(len, lists)))
        doc = np.repeat(np.arange(len(texts)), [len(ts) for ts in lists])
        ends = np.array(self.ends, bool)[ids]
        if self.weights is not None:
            filled = np.array(self.rows.size, np.int64) > 0
            self.full = np.concatenate([self.full[: len(self.sums)], filled]) if len(self.sums) else filled
            self.sums = np.concatenate([self.sums, self.rows.row_sums(self.weights)])
            self.rows = Csr()
            real = self.full[ids]
        else:
            real = np.array(self.rows.size, np.int64)[ids] > 0
        new = np.zeros(len(ids), bool)
        new[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        sentence = np.cumsum(new)
        ids, sentence, doc = ids[real], sentence[real], doc[real]
        first = np.r_[True, sentence[1:] != sentence[:-1]] if len(sentence) else np.zeros(0, bool)
        return ids, np.cumsum(first) - 1, doc[first]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), count))


def train(texts: list, labels: list, buckets: int = 1 << 18, epochs: int = 20, least_steps: int = 900, rate: float = 0.5, l1: float = 3e-4, l2: float = 1e-6, min_df: int = 3, batch: int = 64, seed: int = 7) -> Model:
    """Fit by AdaGrad on the noisy-or's log likelihood. Small samples are passed over more often, for `least_steps` at least.

    After each step the weights in use shrink by `l1`, scaled as the step is, and stop at zero, so that words which mark single
    documents don't explain their labels in place of words which recur. Without labels of both kinds every sentence scores low.
    """
    labels = np.array(labels, np.int64)
    model = Model(np.zeros(buckets), -6.0)
    if not len(texts) or labels.min() == labels.max():
        return model
    words = Words(buckets)
    bags = []
    for a in range(0, len(texts), 256):
        words.grams.memo.clear()
        ids, sentence, doc = words.bags(texts[a : a + 256])
        at = np.searchsorted(doc[sentence], np.arange(len(texts[a : a + 256]) + 1))
        for d, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if hi > lo:
                bags.append((ids[lo:hi].astype(np.int32), (sentence[lo:hi] - sentence[lo]).astype(np.int32), int(sentence[hi - 1] - sentence[lo] + 1), int(labels[a + d])))
    words.memo.clear()
    flat, start, size = words.rows.arrays()
    df = np.zeros(buckets, np.int64)
    for ids, *_ in bags:
        df[np.unique(flat[spread(np.unique(ids), start, size)[0]])] += 1
    known = df >= min_df
    rng, grad2, grad2_b = np.random.default_rng(seed), np.full(buckets, 1e-3), 1e-3
    if not bags:
        return model
    for _ in range(max(epochs, -(-least_steps // -(-len(bags) // batch)))):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            part = [bags[i] for i in order[a : a + batch]]
            counts = np.array([n for _, _, n, _ in part])
            offset = np.cumsum(counts) - counts
            place, token = spread(np.concatenate([i for i, *_ in part]), start, size)
            feature = flat[place]
            token = np.concatenate([s + o for (_, s, _, _), o in zip(part, offset, strict=True)])[token]
            feature, sentence = feature[known[feature]], token[known[feature]]
            doc = np.repeat(np.arange(len(part)), counts)
            y = np.array([v for *_, v in part], float)
            p = logistic(np.bincount(sentence, model.weights[feature], int(counts.sum())) + model.bias)
            whole = np.clip(noisy_or(p, doc, len(part)), 1e-6, 1 - 1e-9)
            # d log-likelihood / d z_s is p_s * (1 - P) / P for label 1 and -p_s for label 0.
            up = p * np.where(y == 1, (1 - whole) / whole, -1.0)[doc]
            g = np.bincount(feature, up[sentence], buckets) / len(part)
            used = np.flatnonzero(g)
            g = g[used] - l2 * model.weights[used]
            grad2[used] += g * g
            step = rate / np.sqrt(grad2[used])
            moved = model.weights[used] + step * g
            model.weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            gb = up.sum() / len(part)
            grad2_b += gb * gb
            model.bias += 0.3 * rate * gb / np.sqrt(grad2_b)
    return model


def labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of a bounded sample of labelled rows. The sampled ids, at most `limit`, are broadcast to the scan; as ids may repeat
    among the documents, so is the number of rows bounded, by 2 * limit."""
    ids = bounded_sample(labels.where(F.col(target).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(target).cast("bigint").alias("_label")), id_col, limit)
    own = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return own.join(F.broadcast(ids), id_col).orderBy(id_col, F.xxhash64("_text")).limit(2 * limit).select("_text", "_label")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """A row per document: score, predicted (1 from 0.5 on), sentence count, and the worst sentence's index and score (null if none).

    keep: further columns of docs that pass through unchanged, as _kept_<name>; with any, so does the text, as _kept_text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        words = Words(len(m.weights), m.weights)
        for b in slices(batches):
            n = b.num_rows
            ids, sentence, doc = words.bags(b.column(1).to_pylist())
            count = np.bincount(doc, minlength=n)
            p = logistic(np.bincount(sentence, words.sums[ids], len(doc)) + m.bias)
            s = np.clip(noisy_or(p, doc, n), 0.0, 1.0)
            by = np.lexsort((np.arange(len(p)), -p, doc))
            start = np.cumsum(count) - count
            top = by[start[count > 0]] if len(p) else np.zeros(0, np.int64)
            at, worst = np.zeros(n, np.int64), np.zeros(n)
            at[count > 0], worst[count > 0] = top - start[count > 0], p[top]
            none = count == 0
            made = [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(at.astype(np.int32), mask=none), pa.array(worst, mask=none)]
            passed, names = (b.columns[1:], ["_kept_text", *b.schema.names[2:]]) if keep else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *passed], ["doc_id", "score", "predicted", "n_sentences", "worst_sentence", "worst_score", *names])

    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("_scored"), *[docs[c].alias(f"_kept_{c}") for c in keep])
    extra = ", _kept_text string" * bool(keep) + "".join(f", `_kept_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, SCHEMA + extra)
