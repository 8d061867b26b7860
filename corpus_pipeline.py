"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
reads them back as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import packing, secrets, simhash, substring, toxicity
from foliospark.llm.common import cut, table
from foliospark.llm.queries import toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shingles of five words and a Jaccard similarity of 0.8; no such pair is missed.
NEAR_DUPLICATES = {"size": 5, "similarity": 0.8}


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; the rest, null and empty texts too, stays as it is."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=("lang", "source", "n_chars"))
    return scored.where("predicted = 0").select("doc_id", *[F.col(f"_kept_{c}").alias(c) for c in COLUMNS[1:]])


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return simhash.keep_one(docs, **NEAR_DUPLICATES).select(*COLUMNS)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; a document that is cut whole stays with an empty text."""
    out = substring.remove(docs, keep=("lang", "source", "n_chars"))
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("_kept_n_chars"))
    return out.select("doc_id", "text", F.col("_kept_lang").alias("lang"), F.col("_kept_source").alias("source"), n.alias("n_chars"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by [REDACTED]."""
    found = secrets.scan(docs)
    text = secrets.redacted(F.col("text"), F.col("found"))
    n = F.when(F.size("found") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or of each of its pieces, in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("substrings", stage_substrings),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]

#: A trained model and packing by search are beyond SQL; tests/llm/test_pipeline.py holds every stage, each on its own input, and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
