"""Intermediate tables in the folder that a cluster's nodes share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests on one machine, it lies under the warehouse; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read again, so that what uses it several times doesn't compute it again."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._folder = path
    return back


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames made by kept(), once all that was derived from them is itself written."""
    for df in frames:
        drop_folder(df.sparkSession, df._folder)
