"""The data source of chunk folders against Spark's own text source and plain listings."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foliospark.sources import artifacts, chunkfolders


@pytest.fixture
def books(tmp_path):
    for book, n in (("a b", 3), ("emma", 5), ("_hidden", 1), ("empty", 0)):
        (tmp_path / book).mkdir()
        for i in range(n):
            (tmp_path / book / f"chunk_{i}.txt").write_text(f"{book} é {i}\n")
    (tmp_path / "emma" / "_notes.json").write_text("{}")
    (tmp_path / "_users.json").write_text("[1]")
    return tmp_path


def rows(frame):
    return sorted(map(tuple, frame.select(F.coalesce("book", F.lit("-")), "name", "text").collect()))


def test_reads_what_spark_reads_and_hidden_names(spark, books):
    got = chunkfolders.read(spark, str(books), "*.txt", part_bytes=20)
    assert got.rdd.getNumPartitions() > 3
    own = sorted((r.book, r.name, r.text) for r in artifacts.chunk_files(spark, str(books)).collect())
    assert [r for r in rows(got) if r[0] != "_hidden"] == own
    assert rows(chunkfolders.read(spark, f"file://{books}", "_*")) == [("-", "_users.json", "[1]"), ("emma", "_notes.json", "{}")]
    assert rows(chunkfolders.read(spark, str(books / "nothing"))) == [] and rows(chunkfolders.read(spark, str(books / "empty"))) == []
    assert {r.bytes for r in got.where("book = 'emma'").collect()} == {len("emma é 0\n".encode())}


def test_filters_reach_the_listing(spark, books, monkeypatch):
    reader = chunkfolders.ChunkReader({"path": str(books), "part_bytes": "1"})
    left = list(reader.pushFilters([chunkfolders.EqualTo(("book",), "emma"), chunkfolders.In(("name",), ["chunk_1.txt", "x"]), chunkfolders.IsNotNull(("book",)), chunkfolders.EqualTo(("bytes",), 3)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"] and [f[0] for p in reader.partitions() for f in p.files] == [f"{books}/emma/chunk_1.txt"]
    got = chunkfolders.read(spark, str(books), part_bytes=1).where("book = 'emma' AND name IN ('chunk_1.txt', 'chunk_2.txt', 'y')")
    assert got.rdd.getNumPartitions() == 2 and [r[1] for r in rows(got)] == ["chunk_1.txt", "chunk_2.txt"]
    assert rows(chunkfolders.read(spark, str(books)).where("book = 'emma' AND book = 'a b'")) == []
    assert len(rows(chunkfolders.read(spark, str(books)).where("book IS NULL"))) == 1


def test_a_stream_reads_each_file_once_over_restarts(spark, books, tmp_path_factory):
    out, checkpoint = (str(tmp_path_factory.mktemp("stream") / k) for k in ("out", "checkpoint"))

    def run():
        stream = chunkfolders.read(spark, str(books), "*.txt", stream=True, settle_ms=0, part_bytes=30)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return rows(spark.read.parquet(out))

    first = run()
    assert first == rows(chunkfolders.read(spark, str(books), "*.txt"))
    (books / "emma" / "chunk_9.txt").write_text("late")
    (books / "new").mkdir()
    (books / "new" / "chunk_0.txt").write_text("new")
    assert run() == sorted([*first, ("emma", "chunk_9.txt", "late"), ("new", "chunk_0.txt", "new")]) == run()


def test_files_that_are_still_fresh_wait(books):
    stream = chunkfolders.ChunkStream({"path": str(books), "settle_ms": "60000"})
    assert stream.latestOffset() == stream.initialOffset()
    os.utime(books / "emma" / "chunk_0.txt", (1, 1))
    assert stream.latestOffset() == {"modified_us": 1_000_000, "path": f"{books}/emma/chunk_0.txt"}
    assert json.loads(json.dumps(stream.latestOffset())) == stream.latestOffset()
