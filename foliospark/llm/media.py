"""Media columns: payloads kept as media files in archives, and a Spark data source that reads them back.

Writing: each task streams its rows into one archive (zip, members stored as they are) under a shared folder. An archive's
name is its attempt's own; only archives listed in the manifest, which Spark commits with the tasks that succeeded, count.

Reading: the data source `media_archive` plans partitions of `range_bytes` over the archives of the manifest. A reader takes
the members whose header lies in its byte range, streams them as Arrow batches of at most `batch_bytes`, and reads each
member by its own offset: if a read fails or its checksum doesn't match, that member alone is read anew, up to `tries` times.

The medium is a PNG of 8-bit grey samples, `ROW` of them in a row, compressed without loss; the length before padding is in a
text chunk. Equal texts give equal files. Null and empty texts are one row of spaces. Null and repeated doc_ids keep
their rows: a member's name starts with its number in the archive.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.llm.common import cut, shared_dir, slices

ROW = 192
FORMAT = "media_archive"
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def file_system(uri: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    height = max(1, -(-len(raw) // ROW))
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row begins with its filter type, 0
    rows[:, 1:] = np.frombuffer(raw.ljust(height * ROW), np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> tuple[bytes, int]:
    """The samples, and the length before padding."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, n = 8, [], 0
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum doesn't match")
        if kind == b"tEXt":
            n = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    return rows[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and the share of samples in each of eight ranges, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    f = x.astype(np.float32)
    step = np.abs(np.diff(f)).mean() if len(f) > 1 else 0.0
    shares = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"mean={f.mean(dtype=np.float64):.3f};dev={f.std(dtype=np.float64):.3f};step={step:.3f};hist=" + ",".join(map(str, shares.tolist()))


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Archives of all rows in a new shared folder; the folder, and the manifest (path, members, bytes)."""
    folder = shared_dir(docs.sparkSession, "archives")

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        path, count, sink, archive = f"{base}/{uuid.uuid4().hex}.zip", 0, None, None
        for b in slices(batches, 256):
            if sink is None:
                sink = fs.open_output_stream(path)
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                archive.writestr(zipfile.ZipInfo(f"{count:08d}_{'null' if d is None else d}.png"), encode(text))
                count += 1
        if sink is not None:
            archive.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([fs.get_file_info(path).size], pa.int64())], ["path", "members", "bytes"])

    picked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return folder, cut(picked.mapInArrow(run, "path string, members bigint, bytes bigint"), "manifest")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def read_member(open_file, info: zipfile.ZipInfo, tries: int = 3, wait: float = 0.2) -> bytes:
    """One member by its offset; each try opens the archive anew after the first."""
    for attempt in range(tries):
        try:
            with open_file() as f:
                f.seek(info.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {info.header_offset}")
                name, extra = struct.unpack_from("<HH", head, 26)
                f.seek(info.header_offset + 30 + name + extra)
                body = f.read(info.compress_size)
            if len(body) != info.compress_size or zlib.crc32(body) != info.CRC:
                raise OSError(f"the member at {info.header_offset} is damaged")
            return body
        except OSError:
            if attempt + 1 == tries:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


class Held:
    """An open archive that read_member can borrow without closing it; a failure closes it, so that the next try reopens."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.file = fs, path, None

    def __call__(self):
        return self

    def __enter__(self):
        if self.file is None:
            self.file = self.fs.open_input_file(self.path)
        return self.file

    def __exit__(self, kind, *_):
        if kind is not None and self.file is not None:
            self.file.close()
            self.file = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["path"], int(options.get("range_bytes", 32 << 20))
        self.batch_bytes, self.tries = int(options.get("batch_bytes", 4 << 20)), int(options.get("tries", 3))
        self.listed = options.get("manifest")

    def partitions(self) -> list[Range]:
        fs, base = file_system(self.folder)
        if self.listed:
            import pyarrow.dataset as ds

            mfs, manifest = file_system(self.listed)
            t = ds.dataset(manifest, filesystem=mfs, format="parquet").to_table(columns=["path", "bytes"])
            files = sorted(zip(t.column("path").to_pylist(), t.column("bytes").to_pylist(), strict=True))
        else:
            found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
            files = sorted((i.path, i.size) for i in found if i.path.endswith(".zip"))
        out = [Range(p, a, min(a + self.range_bytes, n)) for p, n in files for a in range(0, n, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = file_system(self.folder)
        held = Held(fs, part.path)
        with fs.open_input_file(part.path) as f:
            members = [i for i in zipfile.ZipFile(f).infolist() if part.start <= i.header_offset < part.end]
        ids, names, offsets, bodies, size = [], [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "member", "offset", "media"])

        for info in members:
            doc = info.filename.partition("_")[2].removesuffix(".png")
            body = read_member(held, info, self.tries)
            ids.append(None if doc == "null" else int(doc))
            names.append(info.filename)
            offsets.append(info.header_offset)
            bodies.append(body)
            size += len(body)
            if size >= self.batch_bytes:
                yield batch()
                ids, names, offsets, bodies, size = [], [], [], [], 0
        if ids:
            yield batch()


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("manifest", ...).load(folder); without a manifest, all archives of the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, member string, offset bigint, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(FORMAT)
    if manifest is not None:
        files = manifest.inputFiles()
        if not files:
            raise ValueError("the manifest has no files")
        reader = reader.option("manifest", files[0].rpartition("/")[0])
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(folder)


def features(media: DataFrame) -> DataFrame:
    """The digest columns of each member that was read back."""

    def run(batches):
        for b in slices(batches, 256):
            rows = []
            for png in b.column(1).to_pylist():
                payload, n = decode(png)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], [x.split()[0] for x in SCHEMA.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, SCHEMA)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder, manifest = write_archives(docs, id_col, text_col)
    return features(read_archives(docs.sparkSession, folder, manifest))
