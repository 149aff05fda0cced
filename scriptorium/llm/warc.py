"""WARC: a writer of one gzip member per record, and a sequential reader that inflates as it goes.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is a response that carries the
payload; the others are revisit records that name it. A revisit has the HTTP header block only, whose Content-Length is the
length of the full payload. Reading streams each archive in blocks through incremental inflation, one member after another,
takes each record's block by its Content-Length, and verifies block and payload digests where it has them; a record that fails is an
error row. After damage inside a member the reader looks for the next place where a member begins that inflates to a record, so one
damaged member costs its own record only. Any directory of `.warc.gz` files can be read: records of other kinds (warcinfo, request,
metadata, resource) have their block as payload.

Archives are written a task each, named in the messages of the tasks that ended well and listed in a manifest by the commit, so
files of lost or repeated tasks are ignored; a directory without a manifest is read whole. Defined results: null html is empty; rows of equal payload and the same largest id
are all responses; a null page_id is below every other, and where a group has no other id all its rows are responses; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scriptorium.llm.common import opened
from scriptorium.session import ship

MANIFEST = "_manifest.json"
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 16
DATE = "2000-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(uri)}",
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _begins(data: bytes) -> bool:
    """Whether a member begins here and inflates to the start of a record."""
    try:
        return zlib.decompressobj(31).decompress(data, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of one gzip member after another; each must be used up, or fail, before the next.

    After a member that failed, reading goes on at the next place where one begins that holds a record.
    """
    left = b""
    while left or (left := stream.read(BLOCK)):
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal left
            while not inflate.eof:
                if not left and not (left := stream.read(BLOCK)):
                    raise ValueError("archive ends within a member")
                piece = inflate.decompress(left, BLOCK)
                left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()
        if not inflate.eof:
            # What failed may be anywhere in `left`; its own beginning is not the next one.
            left = left[1:]
            while True:
                at = left.find(MAGIC)
                if at < 0:
                    more = stream.read(BLOCK)
                    left = left[-2:] + more if more else b""
                    if not more:
                        break
                    continue
                if len(left) - at < BLOCK and (more := stream.read(BLOCK)):
                    left += more
                if _begins(left[at : at + BLOCK]):
                    left = left[at:]
                    break
                left = left[at + 1 :]


def parse(pieces: Iterator[bytes]) -> dict:
    """A record of a member: headers up to the empty line, then exactly Content-Length bytes, then two line ends."""
    got = bytearray()
    while (end := got.find(b"\r\n\r\n")) < 0:
        got += next(pieces)
    lines = bytes(got[:end]).decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    del got[: end + 4]
    for piece in pieces:
        got += piece
    n = int(head["content-length"])
    block, tail = bytes(got[:n]), bytes(got[n:])
    if len(block) != n or tail != b"\r\n\r\n":
        raise ValueError("block and Content-Length differ")
    kind, payload, size = head["warc-type"], block, n
    if not _same(head.get("warc-block-digest"), block):
        raise ValueError("block digest")
    if head.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length: *(\d+)", http)
        # What a revisit leaves out has the length that its HTTP header tells, if any.
        size = len(payload) if kind != "revisit" else int(told[1]) if told else None
        if kind == "response" and told and not re.search(rb"(?im)^(transfer|content)-encoding:", http) and size != int(told[1]):
            raise ValueError("payload length")
    named = head.get("warc-payload-digest")
    if kind != "revisit" and not _same(named, payload):
        raise ValueError("payload digest")
    named = named.partition(":")[2] if named else None if kind == "revisit" else digest(payload)
    bare = lambda key: head[key].strip("<>") if key in head else None
    return {"record_id": bare("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": named, "refers_to": bare("warc-refers-to"), "payload": None if kind == "revisit" else payload, "error": None}


def _same(named: str | None, data: bytes) -> bool:
    """Whether data has this labelled digest; digests of other kinds than SHA-1 are not verified."""
    return named is None or not named.lower().startswith("sha1:") or named[5:].upper() == digest(data)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = opened(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            if batch.num_rows and out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for kind, key, uri, payload, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(record(kind, key, uri or key, payload or b"", to))
        if out is not None:
            out.close()
        return _Written(name if out is not None else "")

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


class _Archive(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.payloads = str(options.get("payloads", "true")).lower() == "true"

    def partitions(self) -> list[_Archive]:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            names = sorted(f.path[len(root) :].lstrip("/") for f in found if f.is_file and f.path.endswith(".warc.gz"))
        else:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())
        return [_Archive(x) for x in names] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = opened(self.path)
        names = ["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, held = [], 0
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None, buffer_size=BLOCK) as stream:
            for pieces in members(stream):
                try:
                    row = parse(pieces)
                except (ValueError, KeyError, TypeError, StopIteration, zlib.error) as e:
                    row = dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}
                    with contextlib.suppress(ValueError, zlib.error):
                        for _ in pieces:  # what is left of the member
                            pass
                if not self.payloads:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(DataSource):
    """spark.read.format("warc").load(dir); written rows are (record_type, record_id, target_uri, payload, refers_to).

    Options: batchBytes, payloads (false: digests are verified all the same, but payloads aren't returned).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> _WarcWriter:
        return _WarcWriter(self.options["path"])


def _uri(page_id) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0) -> None:
    """Writes one record for each row of pages (page_id, url, html) under `path`, which driver and executors share."""
    ship(pages.sparkSession)
    pages.sparkSession.dataSource.register(Warc)
    page = pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # A digest that no two different payloads share decides equality; SHA-1 is only what the format records.
    page = page.withColumn("key", F.sha2("payload", 256))
    kept = pages.select(F.col("page_id").alias("id"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).filter(F.length("payload") >= min_bytes)
    # Only payloads that several rows share have a say; the rest need no partner in the join.
    kept = kept.groupBy(F.sha2("payload", 256).alias("key")).agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("key", "first")
    rows = page.join(kept, "key", "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows.select(F.when(other, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), _uri(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"), "payload", F.when(other, _uri(F.col("first"))).alias("refers_to")).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Warc)
    return spark.read.format("warc").options(**options).load(path)


def page_of(uri: str) -> Column:
    """The page_id in a record's URI; null where it was null."""
    return F.expr(f"try_cast(substring({uri}, 10) AS BIGINT)")
