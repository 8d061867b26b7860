"""A job store in a SQL database: jobs by JDBC, in parts, with what a listing asks for left to the database.

The table has a row a job: job_id, pipeline, status, manuscript_id, created_at, updated_at and payload, the job as JSON. Conditions on the
frame of rows() are handed to the database by Spark; newest() asks it for a listing's order and limit too, in standard SQL, as Spark's own source
pushes those for some databases only. The payload is parsed for the rows that come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import control

COLUMNS = "job_id string, pipeline string, status string, manuscript_id string, created_at timestamp, updated_at timestamp, payload string"


def rows(spark: SparkSession, url: str, table: str = "jobs", by: str = "created_at", bounds: tuple[str, str] | None = None, parts: int = 8, fetch: int = 1000, **options) -> DataFrame:
    """The table's rows, lower case names. With bounds, (least, most) of the column `by`, in `parts` queries side by side, nulls in the first; else in one.

    Bounds only deal rows out: those beyond them are read too. options: driver, user, password and others of the JDBC source.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if bounds:
        reader = reader.options(partitionColumn=by, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(parts))
    got = reader.load()
    return got.select(*[F.col(c).alias(c.lower()) for c in got.columns])


def bounds_of(spark: SparkSession, url: str, table: str = "jobs", by: str = "created_at", **options) -> tuple[str, str] | None:
    """(least, most) of a column for rows(), computed by the database; None for an empty table."""
    least, most = rows(spark, url, f'(SELECT MIN("{by}") AS least, MAX("{by}") AS most FROM {table}) bounds', **options).select(F.col("least").cast("string"), F.col("most").cast("string")).first()
    return None if least is None else (least, most)


def newest(spark: SparkSession, url: str, limit: int, table: str = "jobs", since: str | None = None, **options) -> DataFrame:
    """The `limit` newest jobs, by falling creation time and then job_id, that meet the conditions: status, pipeline, manuscript_id among the options, and since.

    Filters, order and limit are one query of the database. An empty condition is none.
    """
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    asked = [f'"{c}" = {quoted(v)}' for c in ("status", "pipeline", "manuscript_id") if (v := options.pop(c, None))]
    asked += [f'"created_at" >= CAST({quoted(since)} AS TIMESTAMP)'] if since else []
    where = f" WHERE {' AND '.join(asked)}" if asked else ""
    found = rows(spark, url, f'(SELECT * FROM {table}{where} ORDER BY "created_at" DESC, "job_id" FETCH FIRST {int(limit)} ROWS ONLY) newest', **options)
    return found.orderBy(F.desc("created_at"), F.asc("job_id"))


def jobs(stored: DataFrame) -> DataFrame:
    """control.JOB rows from payloads; those that hold no job are left out."""
    got = stored.select(F.from_json("payload", control.JOB).alias("j"))
    return got.where("j.job_id IS NOT NULL").select("j.*")


def stored_rows(jobs: DataFrame) -> DataFrame:
    """The table's rows (COLUMNS) of control.JOB rows. A job without a manuscript has an empty id there, as not every driver takes null texts."""
    return jobs.select("job_id", "pipeline", "status", F.coalesce("manuscript_id", F.lit("")).alias("manuscript_id"), "created_at", "updated_at", F.to_json(F.struct(*jobs.columns)).alias("payload"))


def write(jobs: DataFrame, url: str, table: str = "jobs", mode: str = "append", **options) -> None:
    """Jobs into the table, which is made where it isn't there."""
    types = "job_id VARCHAR(200), pipeline VARCHAR(200), status VARCHAR(40), manuscript_id VARCHAR(200)"
    stored_rows(jobs).write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=types, **options).mode(mode).save()
