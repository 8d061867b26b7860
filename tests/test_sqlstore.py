"""Jobs in a SQL database: what comes back, and what the database is asked for."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import control
from foliospark.sources import sqlstore

URL = "jdbc:derby:memory:folio;create=true"


@pytest.fixture(scope="module")
def stored(spark):
    asked = spark.range(40).select(
        F.format_string("j%02d", "id").alias("job_id"), F.when(F.col("id") % 3 == 0, "full").otherwise("ingest").alias("pipeline"), *[F.lit(None).cast("string").alias(c) for c in control.REQUEST if c != "manuscript_id"],
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("m"), (F.col("id") % 4).cast("string"))).alias("manuscript_id"), F.create_map(F.lit("k"), F.lit("é")).alias("options"), "id",
    )
    made = control.created(asked, F.timestamp_seconds(F.lit(1_700_000_000)))
    made = made.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.substring("job_id", 2, 2).cast("int") * 3600)).withColumn("status", F.when(F.col("job_id") > "j30", "running").otherwise("queued"))
    sqlstore.write(made, URL, mode="overwrite")
    return made.persist()


def test_jobs_come_back_whole(spark, stored):
    got = sqlstore.jobs(sqlstore.rows(spark, URL))
    assert sorted(map(str, got.collect())) == sorted(map(str, stored.select(got.columns).collect()))


def test_parts_by_bounds(spark, stored):
    bounds = sqlstore.bounds_of(spark, URL)
    rows = sqlstore.rows(spark, URL, bounds=bounds, parts=4)
    assert rows.rdd.getNumPartitions() == 4 and {r[0] for r in rows.select("job_id").collect()} == {f"j{i:02d}" for i in range(40)}
    assert all(n > 0 for n in rows.rdd.glom().map(len).collect())


def test_listings_are_the_databases(spark, stored):
    got = sqlstore.newest(spark, URL, 5, status="queued", pipeline="full", since="2023-11-15 10:00:00")
    want = control.listed(stored.where("status = 'queued' AND created_at >= '2023-11-15 10:00:00'"), pipeline="full").limit(5)
    assert [r.job_id for r in got.collect()] == [r.job_id for r in want.collect()] and got.count() == 5
    assert "FETCH FIRST 5 ROWS ONLY" in got._jdf.queryExecution().executedPlan().toString()
    assert sqlstore.newest(spark, URL, 5, status="it's", pipeline="").collect() == [] and sqlstore.newest(spark, URL, 50).count() == 40


def test_conditions_on_the_frame_are_the_databases(spark, stored):
    got = sqlstore.rows(spark, URL).where("status = 'running' AND pipeline = 'full'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(status,running)" in plan and "Filter" not in plan.replace("PushedFilters", "") and {r.job_id for r in got.collect()} == {"j33", "j36", "j39"}


def test_rows_without_a_job_and_an_empty_table(spark, stored):
    broken = spark.createDataFrame([("x", None, None, None, None, None, "no json"), ("y", None, None, None, None, None, None)], sqlstore.COLUMNS)
    assert sqlstore.jobs(broken).collect() == []
    sqlstore.write(stored.where("false"), URL, "nothing", mode="overwrite")
    assert sqlstore.bounds_of(spark, URL, "nothing") is None and sqlstore.newest(spark, URL, 3, "nothing").collect() == []
