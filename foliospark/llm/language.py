"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else separates words, and the n-grams (1 to 3) of each word with its ends marked are
hashed into buckets. The log-probability matrix (buckets x languages) is broadcast; a batch is scored as a sparse product:
documents x words times words x n-grams times that matrix. Texts that are null or have no letter are `und` with score 0.
Ties go to the language that sorts first. Learning takes a bounded sample of rows with a language (`limit`).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import MEMO, Csr, Grams, Memo, bounded_sample, slices

SCHEMA = "doc_id bigint, lang_pred string, score double"
LETTERS = re.compile(r"[^\W\d_]+")  # runs of letters and of signs such as ½ or Ⅷ, which words_of() parts from them
NGRAMS = (1, 2, 3)


class Model:
    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case."""
    runs = LETTERS.findall((text or "").lower())
    return [w for r in runs for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


def train(texts: list, langs: list, buckets: int = 1 << 16, alpha: float = 0.5) -> Model:
    names = sorted(set(langs))
    at = {x: i for i, x in enumerate(names)}
    of = Grams(NGRAMS, buckets)
    memo = Memo(lambda w: np.array(of(w)))
    counts = np.zeros((len(names), buckets))
    for t, x in zip(texts, langs, strict=True):
        grams = [memo[w] for w in words_of(t)]
        if grams:
            counts[at[x]] += np.bincount(np.concatenate(grams), minlength=buckets)
    docs = np.bincount([at[x] for x in langs], minlength=len(names)) if names else np.zeros(0)
    logp = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * buckets)) if names else counts
    return Model(names, np.log(docs / max(1, docs.sum())) if names else docs, np.ascontiguousarray(logp.T))


def labelled(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang) of a bounded sample of rows whose language is known."""
    own = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    return bounded_sample(own, "_id", limit).select("_text", "_lang")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the likeliest language and its posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.langs)
        rows, matrix, grams = Csr(), np.zeros((0, k)), Grams(NGRAMS, len(m.logp))

        def new(word):
            return len(matrix) + rows.add(grams(word))

        memo = Memo(new)
        for b in slices(batches):
            if len(memo) > MEMO:
                memo.clear()
                matrix = np.zeros((0, k))
            grams.memo.trim()
            n = b.num_rows
            lists = [words_of(t) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in lists], np.int64)
            if k:
                ids = np.fromiter((memo[w] for ws in lists for w in ws), np.int64, int(size.sum()))
                matrix, rows = np.concatenate([matrix, rows.row_sums(m.logp)]), Csr()
                doc = np.repeat(np.arange(n), size)
                z = np.stack([np.bincount(doc, matrix[ids, j], n) for j in range(k)], 1) + m.prior
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = z.argmax(1)
                name = [m.langs[j] if s else "und" for j, s in zip(best.tolist(), size.tolist(), strict=True)]
                s = np.where(size > 0, p[np.arange(n), best], 0.0)
            else:
                name, s = ["und"] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(s)], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
