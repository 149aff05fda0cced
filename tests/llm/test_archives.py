"""Media columns and WARC: exact round trips, members that fail, and the odd cases."""

import base64
import hashlib
import io
import random
import zlib

import pytest

from scriptorium.llm import common, media, warc

TEXTS = [(1, "a"), (2, ""), (3, None), (4, "x" * 64), (5, "é" * 40), (6, "long " * 60_000), (None, "no id"), (7, "again"), (7, "again"), (8, "again"), (9, "\x00\n\x00")]


def test_media_round_trip(spark):
    path = common.scratch(spark, "test-media")
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 AS name", "2 AS content", "3 AS payload").repartition(3)
    media.write_media(df, "doc_id", "text", path)
    got = media.read_media(spark, path, rangeBytes=200, batchBytes=50_000).select("name", "n_bytes", "payload", *media.payload_columns(), "media_bytes", "media_sha256", "feature", "error").collect()
    want = sorted((str(k), media.padded((t or "").encode())) for k, t in TEXTS)
    assert sorted((str(r["name"]), bytes(r["payload"])) for r in got) == want
    for r in got:
        p = bytes(r["payload"])
        assert r["error"] is None and len(p) == r["payload_bytes"] and len(p) % 64 == 0 and len(p) >= 64
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.to_png(p[: r["n_bytes"]])).hexdigest() and len(r["feature"]) == 16
    again = {(r["media_sha256"], r["feature"]) for r in got if r["name"] in ("7", "8")}
    assert len(again) == 1


def test_a_damaged_member_is_its_own_row(spark):
    path = common.scratch(spark, "test-media")
    media.write_media(spark.createDataFrame([(k, f"text {k}") for k in range(5)], "doc_id long, text string").coalesce(1), "doc_id", "text", path)
    fs, root = common.opened(path)
    name = next(f.path for f in fs.get_file_info(common.pa.fs.FileSelector(root)) if f.path.endswith(".zip"))
    data = bytearray(fs.open_input_stream(name).read())
    data[data.index(b"IDAT") + 6] ^= 255
    with fs.open_output_stream(name) as out:
        out.write(bytes(data))
    got = media.read_media(spark, path).collect()
    assert len(got) == 5 and sum(r["error"] is not None for r in got) == 1
    assert all((r["payload"] is None) == (r["error"] is not None) for r in got)


def test_no_media(spark):
    path = common.scratch(spark, "test-media")
    media.write_media(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", path)
    assert media.read_media(spark, path).count() == 0


def test_average_hash_is_exact():
    half = bytes([0] * 64 * 4 + [255] * 64 * 4)
    assert media.average_hash(half) == "00000000ffffffff"
    assert media.average_hash(bytes(64)) == "0" * 16


PAGES = [(1, "u1", "same"), (2, "u2", "same"), (5, None, "same"), (3, "u 3\r\nX: y", "other"), (4, "u4", None), (6, "u6", ""), (None, "n", "same"), (None, "n", "alone"), (7, "u7", "dup"), (7, "u7", "dup"), (8, "u", "WARC/1.1\r\n\r\n" * 9), (9, "v", "big " * 100_000)]


def expected(min_bytes=0):
    out = []
    for k, _, html in PAGES:
        data = (html or "").encode()
        ids = [i for i, _, h in PAGES if (h or "") == (html or "") and i is not None]
        to = max(ids) if ids and len(data) >= min_bytes and k != max(ids) else None
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 4, 5])
def test_warc_round_trip(spark, least):
    path = common.scratch(spark, "test-warc")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS first", "3 AS payload").repartition(3)
    warc.write_warc(df, path, min_bytes=least)
    got = warc.read_warc(spark, path).select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("r"), "payload", "error").collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(least)
    assert all(r["error"] is None and (r["payload"] is None) == (r["record_type"] == "revisit") for r in got)


def test_members_and_damage():
    whole = warc.record("response", "urn:page:1", "u", b"a" * 200_000) + warc.record("response", "urn:page:2", "u", b"b")
    rows = [warc.parse(p) for p in warc.members(io.BytesIO(whole))]
    assert [r["payload"] for r in rows] == [b"a" * 200_000, b"b"]
    plain = zlib.decompress(warc.record("response", "urn:page:1", "u", b"hello"), 31)
    for bad in (plain.replace(b"hello", b"jello"), plain[:-4], plain.replace(b"WARC/1", b"WORC/1")):
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            warc.parse(next(warc.members(io.BytesIO(pack.compress(bad) + pack.flush()))))
    with pytest.raises(ValueError):
        [warc.parse(p) for p in warc.members(io.BytesIO(whole[:-20]))]


def with_length(head, block):
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.0\r\n{head}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def read_all(data):
    out = []
    for pieces in warc.members(io.BytesIO(data)):
        try:
            out.append(warc.parse(pieces)["payload"])
        except (ValueError, zlib.error, StopIteration):
            out.append(None)
    return out


def test_reading_goes_on_after_damage_anywhere():
    rng = random.Random(2)
    bodies = [rng.randbytes(rng.choice([5, 500, 90_000, 200_000])) for _ in range(6)]
    parts = [warc.record("response", f"urn:page:{k}", "u", b) for k, b in enumerate(bodies)]
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    whole = b"".join(parts)
    assert read_all(whole) == bodies
    for k in range(6):
        for place in (0, 3, 12, len(parts[k]) // 2, len(parts[k]) - 6, len(parts[k]) - 1):
            data = bytearray(whole)
            data[starts[k] + place] ^= 0x55
            got = read_all(bytes(data))
            want = [b if j != k else None for j, b in enumerate(bodies)]
            assert got in (want, bodies), (k, place)  # a flipped bit of a header field that nothing checks loses nothing
    assert read_all(whole[: starts[3] + 40])[:3] == bodies[:3]
    assert read_all(b"junk" * 40_000 + whole) == [None, *bodies]


def test_archives_that_others_wrote(spark, tmp_path):
    records = [
        with_length("WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields", b"software: x"),
        with_length("WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nbody"),
        with_length("WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http", b"HTTP/1.1 200 OK\r\n\r\n"),
        with_length("WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:4>\r\nContent-Type: text/plain\r\nWARC-Block-Digest: sha1:AAAA", b"text"),
    ]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "notes.txt").write_text("no archive")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [(r["record_type"], r["payload_bytes"], r["payload"] and bytes(r["payload"]), r["error"]) for r in rows] == [("warcinfo", 11, b"software: x", None), ("response", 4, b"body", None), ("revisit", None, None, None), (None, None, None, "ValueError: block digest")]


def test_media_in_several_archives(spark, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2_000)
    path = common.scratch(spark, "test-media")
    df = spark.createDataFrame([(k, f"text {k} " * 40) for k in range(50)], "doc_id long, text string").coalesce(1)
    spark.dataSource.register(media.MediaArchive)
    df.selectExpr("CAST(doc_id AS STRING) AS name", "CAST(text AS BINARY) AS content").write.format("media_archive").option("archiveBytes", 2_000).mode("append").save(path)
    fs, root = common.opened(path)
    assert sum(f.path.endswith(".zip") for f in fs.get_file_info(common.pa.fs.FileSelector(root))) > 3
    got = media.read_media(spark, path, rangeBytes=500).collect()
    assert sorted(int(r["name"]) for r in got) == list(range(50)) and all(r["error"] is None for r in got)


def test_a_member_whose_bytes_cannot_be_read_costs_itself_only(monkeypatch, tmp_path):
    writer = media._ArchiveWriter(str(tmp_path), 1 << 20)
    batch = common.pa.record_batch([common.pa.array(["1", "2", "3"]), common.pa.array([b"a", b"b", b"c"])], names=["name", "content"])
    writer.commit([writer.write(iter([batch]))])
    reader = media._ArchiveReader({"path": str(tmp_path)})
    [part] = reader.partitions()

    class Odd:
        """A file whose blocks can't be read, though single members can."""

        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read_at(self, size, at):
            if size >= 300:
                raise OSError("a block is lost")
            return self.f.read_at(size, at)

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            return Odd(self.fs.open_input_file(path))

    fs, root = common.opened(str(tmp_path))
    monkeypatch.setattr(media, "opened", lambda path: (Files(fs), root))
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["name"], r["error"]) for r in rows] == [("1", None), ("2", None), ("3", None)]


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_no_pages(spark):
    path = common.scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0
