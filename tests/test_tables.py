"""The chunking table function in SQL, against the fold in a row."""

import random

import pytest

from foliospark.functions import tables
from foliospark.operators import ingest

KINDS = ["Chapter IV", "PART TWO", "* * *", "one two three.", "one two three four five", 'she said "no"', "LOUD LINE", "　Chapter 2", "w " * 25 + "end."]


def test_chunks_in_sql(spark):
    rng = random.Random(7)
    rows = [(b, i, rng.choice(KINDS)) for b in range(30) for i in range(rng.randrange(1, 50))]
    frame = spark.createDataFrame(rows, "book int, para_no int, text string")
    frame.repartition(5).createOrReplaceTempView("paras")
    tables.register(spark)
    got = spark.sql("SELECT * FROM folio_chunks(TABLE(paras), 3, 8, 12)")
    want = ingest.chunk_records(ingest.gathered(frame, "book"), "book", 3, 8, 12)
    columns = ["book", "chunk_no", "n_paragraphs", "word_count", "char_count", "part_hint", "chapter_hint", "text"]
    assert got.columns == ["book", *(f.name for f in tables.CHUNK)]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[c] for c in columns]) for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "SinglePartition" not in plan
    assert spark.sql("SELECT * FROM folio_chunks(TABLE(SELECT * FROM paras WHERE false), 3, 8, 12)").collect() == []


@pytest.mark.parametrize("call", ["TABLE(SELECT 1 AS x), 3, 8, 12", "TABLE(SELECT 1 AS book, 1L AS para_no, 'a' AS text), 9, 8, 12", "TABLE(SELECT 1 AS book, 1L AS para_no, 'a' AS text), 3, 8, CAST(rand() AS INT)"])
def test_wrong_arguments(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="para_no and text|three constants"):
        spark.sql(f"SELECT * FROM folio_chunks({call})").collect()
