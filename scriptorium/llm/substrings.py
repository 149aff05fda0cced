"""Removal of repeated byte strings by refinement of suffix buckets, exact at any offset.

A string of `length` bytes that starts twice anywhere goes, wherever its other occurrences are. All windows of that length are suffixes cut at
`length` bytes; equal ones are found by buckets that are refined from the identifiers of buckets and of bytes at later (and earlier) offsets:

1. Sparse positions. Every window has one anchor: the first of its GRAM-byte grams with the least hash. Equal windows have equal anchors at equal
   offsets, so windows need to be compared only within the bucket of their anchor's gram. Windows side by side with one anchor make a run,
   and a run, not each of its windows, is a row: about one for 180 bytes. These are the initial q-gram buckets.
2. Runs whose whole stretch of bytes is met twice are repeated throughout; one of them stays as a witness for others. Runs alone in their bucket
   are unique. Both leave. So copies, however many, leave at once, and what is left lies at the ends of repeated stretches.
3. Refinement, a few times with the same step. Runs are cut into narrower ones (at most WIDTHS windows), and the identifier of a narrower run's bucket
   is made of that of the bucket it was in and of the bytes at the later and earlier offsets that all its windows share besides. Runs met twice and runs
   alone leave as before; at width 1 all that windows have is shared, so nothing is left.

Rows carry identifiers, never bytes: what is left is met with its own document again in each round. Buckets are never gathered in a task: they are counts by identifier. Rows learn of their bucket by joins in which the
identifiers that hold over 1/SHARE of all rows (of which there are fewer than SHARE) are broadcast, and the rest are shuffled.
Identifiers are 128 bits of a hash of the bytes.

Defined results: a null text is empty; texts under `length` bytes keep everything; repeated rows are documents of their own (and remove each other), also with equal
or null ids. A document is one row of a task, worked through in pieces of PIECE windows, so that memory beyond its text is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import removed, scratch
from scriptorium.llm.lm import stored
from scriptorium.session import ship

LENGTH = 400
GRAM = 64
WIDTHS = (64, 8, 1)  # of runs, in windows, in the rounds of refinement
PIECE = 1 << 20
SHARE = 500
ROWS = 20_000  # of a batch that a task hands on
_WEIGHTS = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) * 2 + 1
#: A run: its anchor, first and last window, whether its whole stretch is known to be met twice, what all in its bucket share (of its document's
#: bytes), and the identifiers. Without an anchor: a span that a document repeats within itself.
_RUNS = "row long, x long, lo long, hi long, many boolean, core_lo long, core_hi long, bucket binary, hull binary"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 32-bit hash of the bytes from each place on, by doubling; gram is a power of two."""
    h, k, factor = _WEIGHTS[data], 1, 0x9E3779B97F4A7C15
    while k < gram:
        h = h[:-k] * np.uint64(factor) + h[k:]
        factor = factor * factor % (1 << 64)
        k *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def window_minima(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours, from minima forward and backward within blocks."""
    n = len(keys) - wide + 1
    full = -(-len(keys) // wide) * wide
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, lo, hi) by pieces: the windows from lo to hi (both in) have the anchor x."""
    windows = len(data) - length + 1
    for at in range(0, windows, piece):
        some = min(piece, windows - at)
        keys = (gram_hashes(np.frombuffer(data, np.uint8, some + length - 1, at), gram) << np.uint64(32)) | np.arange(some + length - gram, dtype=np.uint64)
        x = (window_minima(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(x)) + 1)
        yield x[first] + at, first + at, np.append(first[1:], some) - 1 + at


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _id(*parts: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(parts))


def _bucket(*parts: bytes) -> bytes:
    """A bucket's identifier may be short: two buckets taken for one cost a round, what is equal is told by whole stretches."""
    return xxhash.xxh3_64_digest(b"".join(parts))


def _document(data: bytes, length: int, gram: int) -> tuple[Iterator[tuple], list[tuple[int, int]]]:
    """The runs of a document (x, lo, hi, many, hull), equal stretches once, and the spans that it repeats within itself."""
    met: dict[bytes, list] = {}
    spans: list[tuple[int, int]] = []
    for xs, los, his in runs(data, length, gram, PIECE):
        for x, lo, hi in zip(xs.tolist(), los.tolist(), his.tolist(), strict=True):
            hull = _id(data[lo : hi + length], (x - lo).to_bytes(4, "little"))
            own = met.get(hull)
            if own is None:
                met[hull] = [x, lo, hi, False]
            else:
                if not own[3]:
                    own[3] = True
                    spans.append((own[1], own[2] + length))
                if spans and spans[-1][0] <= lo <= spans[-1][1]:  # as in a text of one letter
                    spans[-1] = (spans[-1][0], max(spans[-1][1], hi + length))
                else:
                    spans.append((lo, hi + length))
    return ((*run, hull) for hull, run in met.items()), merged(spans)


def _map(df: DataFrame, form: str, one) -> DataFrame:
    """The rows that `one` makes of each row, through Arrow; `one` gets the columns in order and gives tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for b in batches:
            for k in range(b.num_rows):
                for made in one(*(c[k].as_py() for c in b.columns)):
                    out.append(made)
                    if len(out) == ROWS:
                        yield batch()
        if out:
            yield batch()

    return df.mapInArrow(run, form)


def _of(df: DataFrame, key: str, chosen: DataFrame, total: int) -> DataFrame:
    """df with the columns of `chosen` (key, n, ...), whose keys are distinct and n counts df's rows: frequent keys by broadcast, others by shuffle."""
    hot = F.col("n") * SHARE > total  # of fewer than SHARE keys
    few, rest = chosen.filter(hot), chosen.filter(~hot)
    split = df.join(F.broadcast(few.withColumnsRenamed({"n": "__n"})), key, "left")
    return split.filter("__n IS NOT NULL").withColumnRenamed("__n", "n").unionByName(df.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def settled(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of runs, the spans (row, start, stop) that are repeated, and what is left to refine; and the paths of the tables.

    What is left has one row for each stretch of bytes in a bucket that has several, of which some may yet be unique.
    """
    total = rows.count()
    # All rows of a class have the same bytes about the anchor; where there is but one, it is itself.
    classes, path = stored(rows.groupBy("hull").agg(F.count("*").alias("n"), F.max("many").alias("many"), F.first(F.struct("row", "x", "lo", "hi", "core_lo", "core_hi", "bucket")).alias("r")), "classes")
    again = classes.filter("n > 1").select("hull", "n")
    spans = _of(rows.filter("NOT many").select("row", "lo", "hi", "hull"), "hull", again, total).select("row", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    left = classes.select("r.*", (F.col("many") | (F.col("n") > 1)).alias("many"))
    buckets, more = stored(left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("many").alias("done")).filter("n > 1 AND NOT done").select("bucket", "n"), "buckets")
    return spans, _of(left, "bucket", buckets, total).drop("n"), [path, more]


def _narrowed(width: int, length: int):
    """What cuts the runs of a document into runs of at most `width` windows, at the same offsets from the anchor for all."""

    def one(row, runs, text):
        data = text.encode()
        for r in runs:
            x, lo, hi = r["x"], r["lo"], r["hi"]
            # Offsets x - start of windows; a cut run has those of [a, a + width).
            for a in range((x - hi) // width * width, x - lo + 1, width):
                first, last = max(lo, x - a - width + 1), min(hi, x - a)
                # What all windows with these offsets share, whether this run has them all or not, is more than before at both ends.
                low, high = min(r["core_lo"], x - a), max(r["core_hi"], x - a - width + 1 + length)
                bucket = _bucket(r["bucket"], a.to_bytes(4, "little"), data[low : r["core_lo"]], data[r["core_hi"] : high])
                yield row, x, first, last, r["many"], low, high, bucket, _id(r["bucket"], (x - first).to_bytes(4, "little"), data[first : last + length])

    return one


def repeated(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> tuple[DataFrame, list[str]]:
    """(row, start, stop): spans of repeated strings in docs (row, text), row being distinct; and the paths of the tables."""
    if gram & (gram - 1) or gram > length or widths[-1] != 1:
        raise ValueError("gram must be a power of two up to length, and the last width 1")

    def anchors(row, text):
        data = (text or "").encode()
        if len(data) >= length:
            found, spans = _document(data, length, gram)
            for x, lo, hi, many, hull in found:
                yield row, x, lo, hi, many, x, x + gram, _bucket(data[x : x + gram]), hull
            for a, b in spans:
                yield row, None, a, b, True, None, None, None, None

    rows, path = stored(_map(docs.select("row", "text"), _RUNS, anchors), "anchors")
    spans, paths = [], []

    def kept(df: DataFrame) -> None:
        found, at = stored(df, "spans")
        spans.append(found)
        paths.append(at)

    kept(rows.filter("x IS NULL").select("row", F.col("lo").alias("start"), F.col("hi").alias("stop")))
    found, left, used = settled(rows.filter("x IS NOT NULL"), length)
    for width in widths:
        kept(found)
        # A document's own runs are gathered, never a bucket.
        wanted = left.groupBy("row").agg(F.collect_list(F.struct("x", "lo", "hi", "many", "core_lo", "core_hi", "bucket")).alias("runs"))
        rows, more = stored(_map(wanted.join(docs.select("row", "text"), "row"), _RUNS, _narrowed(width, length)), "runs")
        removed(docs.sparkSession, path, *used)  # the round before is done with
        path = more
        found, left, used = settled(rows, length)
    kept(found)
    removed(docs.sparkSession, path, *used)
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every, paths


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """The number of bytes removed, of runs removed, and what stays."""
    gone = merged(spans)
    at, parts = 0, []
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return sum(b - a for a, b in gone), len(gone), b"".join(parts)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every document: what is removed, and a digest of what stays."""
    spark = docs.sparkSession
    # Rows are numbered once and keep the numbers, as the table is written.
    own = scratch(spark, "numbered")
    docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).write.option("compression", "zstd").parquet(own)
    numbered = spark.read.schema("row long, doc_id long, text string").parquet(own)
    spans, paths = repeated(numbered, length=length, gram=gram)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def one(doc_id, text, spans):
        data = (text or "").encode()
        gone = merged([(s["start"], s["stop"]) for s in spans or ()])
        n, k, kept = _kept(data, gone)
        yield doc_id, len(data), n, k, hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in gone]

    form = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    done, _ = stored(_map(numbered.join(listed, "row", "left").select("doc_id", "text", "spans"), form, one), "deduplicated")
    removed(spark, own, *paths)
    return done


def kept_text(text: Column, spans: Column) -> Column:
    """What stays of a text, as bytes, given its removed spans in order."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(data).cast("long")))
    hexed = F.hex(data)
    return F.unhex(F.array_join(F.zip_with(stops, starts, lambda a, b: F.substring(hexed, (2 * a + 1).cast("int"), (2 * (b - a)).cast("int"))), ""))
