"""Media columns: texts as 8-bit grey images in archives, read by a data source that plans byte ranges.

`media_archive` is a Spark data source over a directory of zip archives. Writing streams Arrow batches into archives of a bounded
size, one task's one after another; the commit lists the archives of the tasks that ended well in a manifest, so that what lost or repeated tasks wrote is ignored.
Reading plans one partition for each byte range of each archive on the driver from the manifest alone; a partition takes the
members whose local header begins in its range, streams their payloads as Arrow batches of bounded bytes, and reads a member
that fails again by its own offset, with a fresh handle, before it gives the row an `error` instead of a payload. An archive's list of
members is read as often before the task fails, since without it no member is known.

A payload is UTF-8 text with zero bytes up to a positive multiple of 64; it is stored as a PNG of 64 grey samples a row. The
unpadded length is kept in a text chunk. Defined results: a null text is empty; a null id is stored and read as null; repeated
rows are members of their own; an empty table gives an archive directory without archives and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scriptorium.llm.common import opened
from scriptorium.session import ship

WIDTH = 64
ARCHIVE_BYTES = 128 << 20
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"
SCHEMA = "name string, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string, error string"


def padded(content: bytes) -> bytes:
    """content with zero bytes up to a positive multiple of WIDTH."""
    return content + bytes(-len(content) % WIDTH if content else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(content: bytes) -> bytes:
    """The padded content as a PNG of 8-bit grey samples, WIDTH a row; equal contents give equal files."""
    samples = np.frombuffer(padded(content), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # filter type 0 before each row
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(content)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, bytes]:
    """(unpadded length, payload) of what to_png() made; ValueError for anything else or damaged."""
    if media[:8] != PNG:
        raise ValueError("no PNG signature")
    at, size, n, data = 8, None, None, []
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    if size is None or n is None or size[0] != WIDTH or size[2:4] != (8, 0):
        raise ValueError("not an 8-bit grey image of this kind")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return n, rows[:, 1:].tobytes()


def average_hash(payload: bytes) -> str:
    """16 hex digits: which cells of an 8 by 8 grid over the samples are brighter than the whole, in exact integers."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    h = len(samples)
    columns = samples.reshape(h, 8, 8).sum(axis=2, dtype=np.int64)
    running = np.zeros((h + 1, 8), np.int64)
    np.cumsum(columns, axis=0, out=running[1:])
    top = np.arange(8) * h // 8
    end = np.maximum(top + 1, (np.arange(8) + 1) * h // 8)
    sums, counts = running[end] - running[top], (end - top)[:, None] * 8
    bits = sums * samples.size > int(running[-1].sum()) * counts
    return np.packbits(bits).tobytes().hex()


class _ArchiveWriter(DataSourceArrowWriter):
    """A task's archives, in the directory `path`: a new one where one has `archive_bytes`, so that lists of members stay short."""

    def __init__(self, path: str, archive_bytes: int) -> None:
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = opened(self.path)
        names, out, archive, n = [], None, None, 0
        for batch in iterator:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    names.append(f"part-{uuid.uuid4().hex}.zip")
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{names[-1]}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # repeated names are meant
                    archive.writestr(zipfile.ZipInfo("null" if key is None else f"id-{key}"), to_png(content or b""))
                n += 1
                if out.tell() >= self.archive_bytes:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return _Written(names, n)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(x for m in messages if m is not None for x in m.names)
        listed = [{"name": x, "bytes": fs.get_file_info(f"{root}/{x}").size} for x in names]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for x in m.names if m is not None else ():
                fs.delete_file(f"{root}/{x}")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    members: int


class _Range(InputPartition):
    """The members of an archive whose local headers begin at start <= offset < end."""

    def __init__(self, name: str, start: int, end: int) -> None:
        self.name, self.start, self.end = name, start, end


def read_member(fs: pa.fs.FileSystem, path: str, offset: int, size: int, crc: int) -> bytes:
    """A stored member by the offset of its local header alone, with a handle of its own; its checksum is verified."""
    with fs.open_input_file(path) as f:
        head = f.read_at(30, offset)
        sig, names, extra = head[:4], *struct.unpack("<HH", head[26:30])
        if sig != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        data = f.read_at(size, offset + 30 + names + extra)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("member checksum")
    return data


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[_Range]:
        fs, root = opened(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            listed = json.loads(f.read())
        return [_Range(x["name"], s, min(s + self.range_bytes, x["bytes"])) for x in listed for s in range(0, x["bytes"], self.range_bytes)] or [_Range("", 0, 0)]

    def _tried(self, fs: pa.fs.FileSystem, path: str, m: zipfile.ZipInfo) -> tuple:
        why = ""
        for _ in range(self.attempts):
            try:
                media = read_member(fs, path, m.header_offset, m.file_size, m.CRC)
                return media, *from_png(media), None
            except Exception as e:  # noqa: BLE001  any failure of this member is its own row's
                why = f"{type(e).__name__}: {e}"
        return None, None, None, why

    def _members(self, fs: pa.fs.FileSystem, path: str, partition: _Range) -> list[zipfile.ZipInfo]:
        for k in range(self.attempts):
            try:
                with fs.open_input_file(path) as f:
                    return sorted((m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
            except OSError:
                if k == self.attempts - 1:
                    raise
        return []

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = opened(self.path)
        path = f"{root}/{partition.name}"
        schema = pa.schema([("name", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
        rows, held = [], 0
        members = self._members(fs, path, partition)
        with fs.open_input_file(path) as f:
            block, first, size = b"", 0, f.size()
            for m in members:
                need = min(m.header_offset + 30 + 65_536 * 2 + m.file_size, size)
                try:
                    if not first <= m.header_offset or need > first + len(block):
                        block = b""
                        block, first = f.read_at(max(need - m.header_offset, 1 << 20), m.header_offset), m.header_offset
                    at = m.header_offset - first
                    names, extra = struct.unpack_from("<HH", block, at + 26)
                    media = block[at + 30 + names + extra : at + 30 + names + extra + m.file_size]
                    if zlib.crc32(media) != m.CRC:
                        raise ValueError("member checksum")
                    n, payload, why = *from_png(media), None
                except Exception:  # noqa: BLE001  this member alone is read again
                    media, n, payload, why = self._tried(fs, path, m)
                whole = why is None
                rows.append((None if m.filename == "null" else m.filename[3:], n, payload, len(media) if whole else None, hashlib.sha256(media).hexdigest() if whole else None, average_hash(payload) if whole else None, why))
                held += len(payload or b"")
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(dir), df.select(name, content).write.format("media_archive").save(dir).

    Options: rangeBytes (of an archive a partition covers), batchBytes (of payload a batch holds), attempts (for a member); archiveBytes (writing).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> _ArchiveWriter:
        return _ArchiveWriter(self.options["path"], int(self.options.get("archivebytes", ARCHIVE_BYTES)))


def write_media(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Writes each text as an image in archives under `path`, which driver and executors share."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(MediaArchive)
    df.select(F.col(id_col).cast("string").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("content")).write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """name, n_bytes, payload, media_bytes, media_sha256, feature and error of each stored member."""
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def payload_columns(payload: str = "payload") -> list[Column]:
    p = F.col(payload)
    return [F.length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"), F.crc32(F.substr(p, F.length(p) - (WIDTH - 1), F.lit(WIDTH))).alias("tail_crc32")]
