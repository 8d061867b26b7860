"""Helpers shared by the training-data operators."""

from __future__ import annotations

import multiprocessing
import pickle
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 512
#: Words that a worker's memo may hold before it is emptied.
MEMO = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """word -> make(word), emptied between slices once it holds more than MEMO words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > MEMO:
            self.clear()


def fold(key: str = "doc_id", mod: int = 5):
    """crc32 of the key as text, modulo mod: the fold that decides what may be learned from. A null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(0))


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, chosen by a hash of the key, alike on every run and however the rows are dealt.

    One count fixes a hash threshold that lets about 1.2 * limit rows through, so that no task or merge sees more than that.
    """
    total = df.count()
    h = F.xxhash64(F.lit("sample"), F.col(key))
    if total > limit:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * limit / total)) + 1)
    return df.orderBy(h, F.col(key)).limit(limit)


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests on one machine, it lies under the warehouse; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage. The shuffle files behind it are dropped at once."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, kind)
    drop = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(drop, "false")
    spark.conf.set(drop, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(drop, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._folder = path
    return back


def drop_folder(spark: SparkSession, folder: str) -> None:
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(hadoop).delete(path, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames made by cut(), once all that was derived from them is itself written."""
    for df in frames:
        drop_folder(df.sparkSession, df._folder)


def _apart(make, *args) -> bytes:
    """The pickled result of make(*args), from a process that ends with it, so that a reused worker doesn't keep its memory."""
    fork = multiprocessing.get_context("fork")
    here, there = fork.Pipe(duplex=False)
    child = fork.Process(target=lambda: there.send_bytes(pickle.dumps(make(*args))))
    child.start()
    there.close()
    try:
        return here.recv_bytes()
    except EOFError:
        raise RuntimeError("the process that fits the model ended without a result") from None
    finally:
        child.join()


def fitted(sample: DataFrame, train):
    """train(columns as lists) in one task on a bounded sample; the model comes back to the driver."""

    def run(batches):
        columns: list[list] = [[] for _ in sample_names]
        for b in batches:
            for held, c in zip(columns, b.columns, strict=True):
                held.extend(c.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([_apart(train, *columns)], pa.binary())], ["model"])

    sample_names = sample.columns
    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else train(*[[] for _ in sample_names])  # an empty sample may have no task


class Grams:
    """Hashed character n-grams of words whose ends are marked, with a memo of the n-grams themselves."""

    def __init__(self, sizes: tuple[int, ...], buckets: int):
        self.sizes, self.buckets = sizes, buckets
        self.memo = Memo(lambda g: zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets)

    def __call__(self, word: str) -> list[int]:
        b, memo = f"<{word}>", self.memo
        return [memo[b[i : i + n]] for n in self.sizes for i in range(len(b) - n + 1)]


class Csr:
    """Rows of integers of different lengths that grow one by one and can be gathered at once."""

    def __init__(self):
        self.flat, self.size = array("q"), array("q")

    def add(self, row) -> int:
        self.flat.extend(row)
        self.size.append(len(row))
        return len(self.size) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values, and where each row starts and how long it is."""
        size = np.array(self.size, np.int64)
        return np.array(self.flat, np.int64), np.cumsum(size) - size, size

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of values (by integer) over it."""
        flat, start, size = self.arrays()
        if not len(size):
            return np.zeros((0, *values.shape[1:]))
        out = np.add.reduceat(np.concatenate([values[flat], np.zeros((1, *values.shape[1:]))]), start, axis=0)
        out[size == 0] = 0
        return out


def spread(rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in a Csr's values of the given rows one after the other, and for each the index into rows."""
    n = size[rows]
    ends = np.cumsum(n)
    return np.repeat(start[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0), np.repeat(np.arange(len(rows)), n)
