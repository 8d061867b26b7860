"""Folders of chunk files as a data source: <path>/<book>/<name>, in batch and as a stream.

Partitions are planned from file names and sizes, so that a large book is many tasks and small books share one; filters on book and name
decide which folders and files are looked at. Unlike Spark's own file sources it also reads names that begin with an underscore, and files that lie
in <path> itself (their book is null). Files are read where the tasks run, through pyarrow's file systems: every node must see the path.
As a stream its offset is the newest file seen, by time and then path; files count once they have been left alone for `settle_ms`, so that
no file that is still written, or as new as one seen, is passed over. Files that are moved in with an older time than the offset aren't seen.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

FORMAT = "chunk_folders"
SCHEMA = pa.schema([("book", pa.string()), ("name", pa.string()), ("modified_us", pa.int64()), ("bytes", pa.int64()), ("text", pa.string())])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class Files(InputPartition):
    """Some of a folder's files: (path, book, modified_us, bytes) each."""

    def __init__(self, files: list[tuple]):
        self.files = files


class Folder:
    """What the options say, and the listing, planning and reading that batch and stream share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.patterns = [p for p in options.get("names", "*").split(",") if p]
        self.part_bytes, self.batch_bytes = int(options.get("part_bytes", 32 << 20)), int(options.get("batch_bytes", 4 << 20))
        self.settle_ms = int(options.get("settle_ms", 2000))

    def listed(self, books: set[str] | None = None, names: set[str] | None = None) -> list[tuple]:
        """(path, book, modified_us, bytes), by path; of the books and names asked for only, other folders aren't opened."""
        fs, base = file_system(self.path)
        top = [i for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.type == pafs.FileType.File or books is None or i.base_name in books]
        found = [(i, None) for i in top if i.type == pafs.FileType.File and books is None]
        for folder in top:
            if folder.type == pafs.FileType.Directory:
                found += [(i, folder.base_name) for i in fs.get_file_info(pafs.FileSelector(folder.path, allow_not_found=True)) if i.type == pafs.FileType.File]
        wanted = lambda n: any(fnmatchcase(n, p) for p in self.patterns) and (names is None or n in names)
        return sorted((i.path, book, (i.mtime_ns or 0) // 1000, i.size) for i, book in found if wanted(i.base_name))

    def planned(self, files: list[tuple]) -> list[Files]:
        """Parts of about part_bytes; a file is in one of them."""
        out, size = [], 0
        for f in files:
            if not out or size + f[3] > self.part_bytes:
                out.append([])
                size = 0
            out[-1].append(f)
            size += f[3]
        return [Files(part) for part in out] or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for path, book, modified, _ in part.files:
            with fs.open_input_file(path) as f:
                body = f.read()
            rows.append((book, path.rpartition("/")[2], modified, len(body), body.decode("utf-8", "replace")))
            size += len(body)
            if size >= self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.books, self.names = Folder(options), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and lists on book and name, and that they aren't null: they hold of all that is read."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column not in ("book", "name"):
                yield f
            elif isinstance(f, IsNotNull):
                if column == "book":
                    yield f
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = getattr(self, f"{column}s")
                setattr(self, f"{column}s", values if held is None else held & values)

    def partitions(self) -> list[Files]:
        return self.folder.planned(self.folder.listed(self.books, self.names))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class ChunkStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"modified_us": -1, "path": ""}

    def _between(self, start: dict, end: dict | None, until: float) -> list[tuple]:
        at = lambda o: (o["modified_us"], o["path"])
        got = [f for f in self.folder.listed() if at(start) < (f[2], f[0]) and (f[2] <= until if end is None else (f[2], f[0]) <= at(end))]
        return sorted(got, key=lambda f: (f[2], f[0]))

    def latestOffset(self) -> dict:
        files = self._between(self.initialOffset(), None, time.time() * 1e6 - self.folder.settle_ms * 1000)
        return {"modified_us": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.folder.planned(self._between(start, end, 0))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class ChunkFolders(DataSource):
    """spark.read.format("chunk_folders").option("names", "*.txt,_users.json").load(path); options part_bytes, batch_bytes and, for streams, settle_ms."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "book string, name string, modified_us bigint, bytes bigint, text string"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(dict(self.options))

    def streamReader(self, schema) -> ChunkStream:
        return ChunkStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets Spark hand it filters."""
    spark.dataSource.register(ChunkFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, names: str = "*", stream: bool = False, **options) -> DataFrame:
    """(book, name, modified_us, bytes, text) of the files whose names match one of the patterns, comma between them."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(FORMAT).option("names", names)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
