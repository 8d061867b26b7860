"""The operators' queries against their SQL."""

import duckdb
import pytest

from foliospark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
