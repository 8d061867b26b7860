"""Files that runs leave behind: chunk texts, outputs of passes, manifests, job stores and configurations, as tables and back.

Files are read whole by Spark's text source, so any store that Spark reads will do. What isn't there is no row; what can't be parsed is
a row with an error.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.utils import AnalysisException

from foliospark.functions import jsonx
from foliospark.functions import text as T
from foliospark.operators import control, passes
from foliospark.sources import chunkfolders

# Tables that a job store keeps in one file each, by file name.
STORE = {"workers": "_workers.json", "users": "_users.json", "manuscripts": "_manuscripts.json", "config_profiles": "_config_profiles.json", "artifact_index": "_artifact_index.json"}
#: Sections that a configuration must have.
SECTIONS = ("paths", "models", "timeouts", "chunking", "logging")


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, value) of the files under a folder whose names match, each one row; no rows where there is no such file."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    try:
        return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, value string")
        raise


def _part(path: Column, from_end: int) -> Column:
    """The n-th last part of a path, percent signs decoded."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -from_end), F.lit("+"), F.lit("%2B")))


def chunk_files(spark: SparkSession, path: str, endings: tuple = ("txt",)) -> DataFrame:
    """(book, name, place, text): chunk texts under <path>/<book>/, in the natural order of their names within the book."""
    rows = reduce(DataFrame.union, [whole_files(spark, path, f"*.{e}") for e in endings])
    own = rows.select(_part(F.col("path"), 2).alias("book"), _part(F.col("path"), 1).alias("name"), F.col("value").alias("text"))
    return own.withColumn("place", F.row_number().over(W.partitionBy("book").orderBy(T.natural_key(F.col("name")))) - 1)


def pass_files(spark: SparkSession, path: str) -> DataFrame:
    """(book, chunk_id, pos, pass, doc, load_error): the outputs <path>/<book>/chunk_*/<pass>.json, pos by the natural order of the chunks.

    The passes are structure, dialogue, entities, dossiers and timing. A file that can't be parsed counts as there: its doc is {} and it has an error.
    """
    rows = whole_files(spark, path, "*.json").select(_part(F.col("path"), 3).alias("book"), _part(F.col("path"), 2).alias("chunk_id"), _part(F.col("path"), 1).alias("file"), F.col("value").alias("doc"))
    own = rows.where(F.col("chunk_id").startswith("chunk_")).withColumn("pass", F.regexp_replace("file", r"\.json$", "")).where(F.col("pass").isin(*passes.PASS_FILES))
    bad = jsonx.whole(F.col("doc")).isNull()
    order = F.dense_rank().over(W.partitionBy("book").orderBy(T.natural_key(F.col("chunk_id")), "chunk_id")) - 1
    return own.select("book", "chunk_id", order.alias("pos"), "pass", F.when(bad, "{}").otherwise(F.col("doc")).alias("doc"), F.when(bad, F.concat(F.lit("Could not parse "), "file")).alias("load_error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(book, book_title, chunk_id, entry): the chunks of <path>/<book>/chunk_manifest.json, the last of a repeated id; entry is the VARIANT."""
    rows = whole_files(spark, path, "chunk_manifest.json").select(_part(F.col("path"), 2).alias("book"), jsonx.whole(F.col("value")).alias("v"))
    each = rows.select("book", jsonx.string(F.col("v"), "$.book_title").alias("book_title"), F.posexplode(jsonx.items(F.col("v"), "$.chunks")).alias("i", "entry"))
    named = each.withColumn("chunk_id", jsonx.string(F.col("entry"), "$.chunk_id")).where("chunk_id <> ''")
    last = W.partitionBy("book", "chunk_id").orderBy(F.desc("i"))
    return named.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("book", "book_title", "chunk_id", "entry")


def with_manifest(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """chunks(book, chunk_id, ...) with manifest_entry, null where the manifest has none."""
    return chunks.join(entries.select("book", "chunk_id", F.col("entry").alias("manifest_entry")), ["book", "chunk_id"], "left")


def job_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A folder of job files, on a path that all nodes see, as tables: jobs (control.JOB) and, as VARIANTs v, the rows of workers, users, manuscripts and config_profiles, and the artifact index."""
    rows = whole_files(spark, path, "*.json")
    out = {"jobs": rows.select(F.from_json("value", control.JOB).alias("j")).where("j.job_id IS NOT NULL").select("j.*")}
    for name, file in STORE.items():
        v = chunkfolders.read(spark, path, names=file).where("book IS NULL").select(jsonx.whole(F.col("text")).alias("v"))
        if name == "artifact_index":
            entries = v.select(F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e"))
            out[name] = entries.select(F.col("e.key").alias("job_id"), F.explode(jsonx.items(F.col("e.value"), "$")).alias("v"))
        else:
            out[name] = v.select(F.explode(jsonx.items(F.col("v"), "$")).alias("v"))
    return out


@F.pandas_udf(StringType())
def indented(docs: pd.Series) -> pd.Series:
    """JSON with two spaces of indent, other letters than ASCII as they are."""
    return docs.map(lambda d: None if d is None else json.dumps(json.loads(d), indent=2, ensure_ascii=False))


def write_texts(files: DataFrame, path: str, folders: list[str], body: str = "body", mode: str = "errorifexists") -> None:
    """Each row's text, a line break after it, as a file of its own under <path>/<folder>=<value>/...: one shuffle, then every task writes its files.

    Chunk texts go by folders ["book", "chunk_id"], documents by ["book", "name"].
    """
    files.select(*folders, body).repartition(*folders).write.partitionBy(*folders).mode(mode).text(path)


def write_json(files: DataFrame, path: str, folders: list[str], body: str = "body", mode: str = "errorifexists") -> None:
    """write_texts() of JSON documents, indented."""
    write_texts(files.withColumn(body, indented(body)), path, folders, body, mode)


def read_texts(spark: SparkSession, path: str, folders: list[str], body: str = "body") -> DataFrame:
    """What write_texts() has written."""
    schema = ", ".join([*(f"`{f}` string" for f in folders), f"`{body}` string"])
    got = spark.read.schema(schema).format("text").option("wholetext", True).load(path)
    return got.select(*folders, F.regexp_replace(body, "\n$", "").alias(body))


def config(text: str) -> dict:
    """A YAML configuration as a mapping. ValueError unless its top is a mapping with all SECTIONS."""
    import yaml

    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("the top level of a configuration must be a mapping")
    missing = [s for s in SECTIONS if s not in data]
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    return data
