"""Exact top-k inner products of a query set against all rows.

Vectors are quantised to integers, floor(scale * x), and written once in the order of falling length, in lanes of about LANE
rows. All are rotated by the right singular vectors of a bounded sample, which leaves inner products as they are (any
rotation would) and gathers length in the first coordinates. Each query first meets the longest vectors, a bounded head that
is broadcast, and takes its k-th best score there as a threshold. Then the queries, in blocks of a bounded number of
components, are broadcast one block after the other, and every lane streams past the block:

* a query leaves a chunk of a lane when its length times the chunk's longest can't reach its threshold (Cauchy-Schwarz);
* for the rest the partial products over the first coordinates are extended, coordinates by coordinates, as dense tiles. At
  each cut the partial product plus the product of the residual lengths bounds the score, and rows and columns
  of a tile that no pair keeps alive are left out of what follows;
* pairs whose finished product is within rounding of the threshold are scored exactly, on the integers.

Thresholds rise as a task goes on. Candidates aren't shuffled and aren't copied; what a lane found is ranked per query.

Vectors that are null, hold a null or non-finite component (as such or after scaling), or whose id is null take no part;
shorter vectors count as padded with zeros. A query excludes its own row only: other rows of the same id remain candidates, and
each row of a repeated id asks for itself. Scores beyond a long are given, and compared, as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_sample, cut, drop, drop_folder, fitted, shared_dir

#: Rows of a lane; components of a query block or of the head, which are broadcast; rows that the rotation is fitted on.
LANE, CELLS, HEAD_CELLS, SAMPLE = 32768, 1 << 20, 1 << 17, 4096
#: Queries and candidates of a tile; coordinates that are rotated at most.
TILE, CHUNK, ROTATED = 1024, 2048, 1024
#: Shares of the coordinates after which a tile's bounds are taken.
CUTS = (0.25, 0.5)
LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm) of each row that takes part; the components are integers held as doubles, so that those beyond a long stay exact."""

    def floored(batches):
        for b in batches:
            flat, at = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False)), starts(b.column(1))
            with np.errstate(over="ignore"):
                norm = np.sqrt(np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), flat * flat, minlength=len(at) - 1))
            v = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(norm, pa.float64())], ["vec_id", "v", "norm"])

    scaled = F.transform(vectors[vec_col], lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), scaled.alias("x"))
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole).mapInArrow(floored, "vec_id bigint, v array<double>, norm double")


def starts(col) -> np.ndarray:
    """Where each row of a list column starts in its flattened values, and where the last ends."""
    at = col.offsets.to_numpy() if len(col) else np.zeros(1, np.int32)
    return at - at[0]


def dense(col, dim: int) -> np.ndarray:
    """A list column as a matrix of doubles, padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    out = np.zeros((len(col), dim))
    out[np.arange(dim)[None, :] < np.diff(starts(col))[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors, by falling singular value, of a bounded sample's first ROTATED coordinates; the others stay."""

    def train(_, vectors):
        m = min(dim, ROTATED)
        x = np.zeros((len(vectors), m))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v[:m]
        gram = x.T @ x
        return np.linalg.eigh(gram)[1][:, ::-1] if np.isfinite(gram).all() else np.eye(m)

    turn = np.eye(dim)
    turned = fitted(bounded_sample(rows.select("uid", "v"), "uid", SAMPLE), train)
    turn[: len(turned), : len(turned)] = turned
    return turn


class Block:
    """Queries with what they have found so far. Rows are processed by chunks; found() gives (row, vec_id, score)."""

    def __init__(self, uid: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.uid, self.v, self.turn, self.k, dim = uid, v, turn, k, v.shape[1]
        self.kth = np.full(len(uid), -np.inf) if kth is None else kth.astype(float)
        self.cuts = sorted({c for share in CUTS if 0 < (c := round(dim * share)) < dim})
        self.q = v @ turn
        self.length = np.sqrt((v**2).sum(1))
        self.rest = [np.sqrt((self.q[:, c:] ** 2).sum(1)) for c in self.cuts]
        self.best = [(np.zeros(0, np.int64),) * 3 for _ in range(0, len(uid), TILE)]
        self.scored = self.pairs = 0

    def meet(self, uid: np.ndarray, vec_id: np.ndarray, v: np.ndarray) -> None:
        """Take candidates into account, whatever their order; they are taken by falling length."""
        length = np.sqrt((v**2).sum(1))
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), CHUNK):
            own = order[a : a + CHUNK]
            self._chunk(uid[own], vec_id[own], v[own], length[own])

    def _chunk(self, uid, vec_id, v, length) -> None:
        most = self.length.max(initial=0) * length[0]
        self.pairs += len(self.uid) * len(uid)
        if not most < 1e300:  # products may be beyond a double: no bounds, every pair is scored on integers
            for t in range(len(self.best)):
                on = np.arange(t * TILE, min(len(self.uid), (t + 1) * TILE))
                i, j = np.indices((len(on), len(uid)))
                self._score(t, on[i.ravel()], j.ravel(), uid, vec_id, v, False)
            return
        c = v @ self.turn
        rest = [np.sqrt((c[:, x:] ** 2).sum(1)) for x in self.cuts]
        slack = 1e-9 * self.length * length[0] + 1e-6
        for t in range(len(self.best)):
            tile = np.arange(t * TILE, min(len(self.uid), (t + 1) * TILE))
            on = tile[self.length[tile] * length[0] + slack[tile] >= self.kth[tile]]
            cols, part, before = np.arange(len(uid)), 0.0, 0
            for x, q_rest, c_rest in zip(self.cuts, self.rest, rest, strict=True):
                if not len(on) or not len(cols):
                    break
                part = part + self.q[on, before:x] @ c[cols, before:x].T
                alive = part + q_rest[on, None] * c_rest[cols][None, :] >= (self.kth - slack)[on, None]
                rows, keep = alive.any(1), alive.any(0)
                if rows.mean() * keep.mean() < 0.9:
                    part, on, cols = part[np.ix_(rows, keep)], on[rows], cols[keep]
                before = x
            if not len(on) or not len(cols):
                continue
            part = part + self.q[on, before:] @ c[cols, before:].T
            least = self.kth[on].copy()
            unset = np.isneginf(least)
            if unset.any() and len(cols) > self.k:  # with the own row k + 1 reach it
                least[unset] = np.partition(part[unset], len(cols) - self.k - 1, axis=1)[:, len(cols) - self.k - 1]
            i, j = np.nonzero(part >= (least - 2 * slack[on])[:, None])
            self._score(t, on[i], cols[j], uid, vec_id, v, most < 2**52)

    def _score(self, t: int, i: np.ndarray, j: np.ndarray, uid, vec_id, v, doubles: bool) -> None:
        """Score the pairs exactly and keep each query's k best. doubles: sums of the integers' products are exact as doubles."""
        other = self.uid[i] != uid[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        self.scored += len(i)
        if doubles:
            s = np.concatenate([np.einsum("ij,ij->i", self.v[i[p : p + 65536]], v[j[p : p + 65536]]) for p in range(0, len(i), 65536)]).astype(np.int64)
        else:
            exact = (sum(int(x) * int(y) for x, y in zip(self.v[a], v[b], strict=True)) for a, b in zip(i, j, strict=True))
            s = np.array([max(-LONG - 1, min(LONG, x)) for x in exact], np.int64)
        good = s >= self.kth[i]
        row, ids, score = (np.r_[x, y] for x, y in zip(self.best[t], (i[good], vec_id[j[good]], s[good]), strict=True))
        by = np.lexsort((ids, -score.astype(float), row)) if doubles else np.array(sorted(range(len(row)), key=lambda x: (row[x], -int(score[x]), ids[x])), np.int64)
        row, ids, score = row[by], ids[by], score[by]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        keep = place < self.k
        last = place == self.k - 1
        # Saturated scores round up as doubles, so their threshold is lowered by one step.
        reached = score[last].astype(float) if doubles else np.nextafter(score[last].astype(float), -np.inf)
        self.kth[row[last]] = np.maximum(self.kth[row[last]], reached)
        self.best[t] = row[keep], ids[keep], score[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([b[x] for b in self.best] or [np.zeros(0, np.int64)]) for x in range(3))


def matrix(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, vec_id, v) of a bounded number of rows, on the driver."""
    got = rows.select("uid", "vec_id", "v").toArrow()
    return got.column("uid").to_numpy(), got.column("vec_id").to_numpy(), dense(got.column("v"), dim)


def thresholds(asked: DataFrame, head: tuple, turn: np.ndarray, k: int) -> DataFrame:
    """asked with kth: each query's k-th best score among the head's rows; minus infinity where there are fewer."""
    dim = len(turn)

    def run(batches):
        for b in batches:
            own = Block(b.column(0).to_numpy(), dense(b.column(2), dim), turn, k)
            own.meet(*head)
            row, _, score = own.found()
            kth = np.full(b.num_rows, np.inf)
            np.minimum.at(kth, row, np.nextafter(score.astype(float), -np.inf))
            kth[np.bincount(row, minlength=b.num_rows) < k] = -np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kth)], ["uid", "vec_id", "v", "kth"])

    return asked.select("uid", "vec_id", "v").mapInArrow(run, "uid bigint, vec_id bigint, v array<double>, kth double")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", lane: int = LANE, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition on vec_id that picks the queries."""
    spark = vectors.sparkSession
    lanes = max(1, -(-vectors.count() // lane))
    sorted_ = quantised(vectors, scale, id_col, vec_col).repartitionByRange(lanes, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"))
    rows = cut(sorted_.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    dim, n_q = rows.agg(F.max(F.size("v")), F.count_if(is_query)).first()
    dim = max(1, dim or 0)
    turn = rotation(rows, dim)
    head = matrix(rows.orderBy(F.desc("norm"), "uid").limit(max(k + 1, HEAD_CELLS // dim)), dim)
    blocks = max(1, -(-n_q * dim // cells))
    asked = thresholds(rows.where(is_query), head, turn, k).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    queries = shared_dir(spark, "queries")
    asked.write.partitionBy("block").parquet(queries)
    asked = spark.read.schema("uid bigint, vec_id bigint, v array<double>, kth double, block int").parquet(queries)

    out = shared_dir(spark, "top-k")
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    rank = F.row_number().over(W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    for number in range(blocks):
        own = asked.where(F.col("block") == number).select("uid", "vec_id", "v", "kth").toArrow()
        held = spark.sparkContext.broadcast((own.column("uid").to_numpy(), own.column("vec_id").to_numpy(), dense(own.column("v"), dim), own.column("kth").to_numpy()))
        found = rows.select("uid", "vec_id", "v").mapInArrow(_stream(held, turn, k), "query_uid bigint, query_id bigint, vec_id bigint, score bigint")
        found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        held.destroy()
    drop(rows)
    drop_folder(spark, queries)
    return spark.read.schema(schema).parquet(out)


def _stream(held, turn: np.ndarray, k: int):
    """What a lane finds for the broadcast block."""

    def run(batches):
        uid, ids, v, kth = held.value
        own = Block(uid, v, turn, k, kth)
        for b in batches:
            own.meet(b.column(0).to_numpy(), b.column(1).to_numpy(), dense(b.column(2), len(turn)))
        row, vec_id, score = own.found()
        for a in range(0, len(row), 65536):
            p = slice(a, a + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(uid[row[p]]), pa.array(ids[row[p]]), pa.array(vec_id[p]), pa.array(score[p])], ["query_uid", "query_id", "vec_id", "score"])

    return run
