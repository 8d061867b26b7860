"""A latest-state table that a stream keeps: one merged row per key, upserted batch by batch, each batch once.

The table is <path>/bucket=<hash of the key>/version=<batch>/. A batch reads the rows of its buckets from versions before it, merges its own and writes
their buckets as its version, over whatever an earlier try of the same batch has left. Then <path>/_committed holds the batch's number,
and versions that nothing needs any more go. A batch that is tried again therefore gives what it would have given once, whenever its first
try was killed; and a reader that asks for the committed version sees no half-written batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of a table, each rewritten only by batches that touch its keys.
BUCKETS = 64


class LatestTable:
    """fold: rows of a batch -> states with the keys; merge: states -> one per key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.fold, self.merge, self.buckets = spark, path.rstrip("/"), keys, fold, merge, buckets
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def committed(self) -> int:
        return max([int(n) for n in self._names("_committed")], default=-1)

    def versions(self, bucket: int) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self._names(f"bucket={bucket}") if n.startswith("version="))

    def _read(self, buckets: list[int], until: int, schema) -> DataFrame:
        """The buckets' rows as they are after the batch `until`."""
        newest = {b: max([v for v in self.versions(b) if v <= until], default=None) for b in buckets}
        folders = [f"{self.path}/bucket={b}/version={v}" for b, v in newest.items() if v is not None]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def current(self, schema) -> DataFrame:
        """The states after the last committed batch."""
        return self._read(list(range(self.buckets)), self.committed(), schema)

    def write(self, batch: DataFrame, number: int) -> None:
        """The sink of foreachBatch. At most `buckets` numbers come to the driver."""
        if number <= self.committed():
            return
        states = self.merge(self.fold(batch)).persist()
        try:
            own = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            touched = sorted(r[0] for r in states.select(own).distinct().collect())
            after = self.merge(self._read(touched, number - 1, states.schema).unionByName(states))
            dealt = after.withColumn("bucket", own).withColumn("version", F.lit(number)).repartition("bucket")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
        finally:
            states.unpersist()
        self._commit(number, touched)

    def _commit(self, number: int, touched: list[int]) -> None:
        self.fs.mkdirs(self._path("_committed"))
        self.fs.create(self._path("_committed", str(number)), True).close()
        for n in self._names("_committed"):
            if int(n) < number:
                self.fs.delete(self._path("_committed", n), False)
        for b in touched:  # a reader may still hold the version before
            for v in self.versions(b)[:-2]:
                self.fs.delete(self._path(f"bucket={b}", f"version={v}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        out = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if available_now else out).start()
