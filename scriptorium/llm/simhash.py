"""SimHash near-duplicates: fingerprints, pivot distance tables, and connected components of what links.

Fingerprints. Texts with A-Z lower-cased are split at ASCII white space; a shingle is `words` words joined by spaces (fewer words:
the whole sequence; none: fingerprint zero); its hash is XXH64 with seed 42, and a fingerprint bit is set in over half the hashes.

Links. Two fingerprints link at 2 or fewer differing bits. The pivot table holds, for every distinct fingerprint, its Hamming distances
to reference fingerprints, computed once: to zero, to the 64 unit fingerprints, and to REFERENCES random ones. If two fingerprints link, no two
coordinates differ by more than 2. Candidates come from blocks of coordinates: the distance to a unit fingerprint less that to zero tells
a bit, so the coordinates of 16 units are a block of 16 bits, and fingerprints with at most 2 differing bits agree in two of four blocks.
Each is listed under its six pairs of blocks; keys that a single one has are discarded. Members of a key are paired where they are PAIRED
or fewer; pairs whose largest coordinate difference is over 2 are discarded, and survivors are verified by their own Hamming distance.

Keys with more members would give pairs with the square of their number. Their members take an exact way that doesn't: each is
listed under its own point of the lattice of unit distances and the 64 next to it, since fingerprints at 2 bits share a point
one move from each; at a point at most 65 meet, all of which link, and each is linked with the least of its point only.

Components come from alternating rounds of large and small stars over the links, each round written to the shared folder.

Defined results: a null or empty text has fingerprint zero; a null doc_id takes part by its text and never names a component unless
all ids of it are null (then component_id is null); repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import written
from scriptorium.session import ship

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCKS, PAIRED = 4, 16
#: References: zero and the unit fingerprints, whose coordinates are bits, and random ones, against which pairs are tested.
UNITS = (0, *(1 << k for k in range(64)))
REFERENCES = tuple(xxhash.xxh64_intdigest(b"reference %d" % k, SEED) for k in range(32))


def shingle_hashes(text: bytes, words: int = SHINGLE) -> list[int]:
    """The hashes of all shingles of a text, repeats included."""
    parts = text.lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    h = shingle_hashes(text, words)
    return majority(np.array(h, np.uint64)) if h else 0


def with_fingerprints(docs: DataFrame, keep: list[Column], schema: str, *, text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """The kept columns and `fp`, the fingerprint of the whole text as a signed 64-bit number."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [fingerprint(t or b"", words) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(own, np.uint64).view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("__text")).mapInArrow(run, f"{schema}, fp long")


def _lit(n: int) -> Column:
    return F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast("long")


def pivot_distances(fp: str, references: tuple[int, ...]) -> Column:
    """The Hamming distances of a fingerprint to the references."""
    return F.array(*(F.bit_count(F.col(fp).bitwiseXOR(_lit(r))) for r in references))


def lattice_points(fp: str) -> Column:
    """The fingerprint's own point and those one unit move away, named by the fingerprint that has these distances."""
    return F.array(*(F.col(fp).bitwiseXOR(_lit(u)) for u in UNITS))


def block_keys(fp: str) -> Column:
    """The keys of a fingerprint: each pair of blocks of unit coordinates, all of one key the same. The pair's number is in the bits left out."""
    width = 64 // BLOCKS
    keys = []
    for n, (i, j) in enumerate(itertools.combinations(range(BLOCKS), 2)):
        mask = sum(((1 << width) - 1) << width * k for k in (i, j))
        out = next(k for k in range(BLOCKS) if k not in (i, j))
        keys.append(F.col(fp).bitwiseAND(_lit(mask)).bitwiseOR(_lit(n + 1 << width * out)))
    return F.array(*keys)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, coordinates): distances of the distinct fingerprints to the random references, one byte each."""
    return distinct.select("fp", pivot_distances("fp", REFERENCES).cast("array<tinyint>").alias("coordinates"))


def candidates(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded): pairs (x, y) of rows of the pivot table that share a key of PAIRED members or fewer, and the members (fp) of all other keys."""
    listed = table.select(F.struct("fp", "coordinates").alias("x"), F.explode(block_keys("fp")).alias("key"))
    # Counts are summed before they are dealt, and a key's rows are not gathered before it is known to have few.
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = listed.join(sizes, "key")
    groups = met.filter(F.col("n") <= PAIRED).groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = groups.select(F.posexplode("xs").alias("k", "y"), "xs").select("y", F.explode(F.slice("xs", F.lit(1), F.col("k"))).alias("x"))
    return pairs, met.filter(F.col("n") > PAIRED).select("x.fp").distinct()


def survivors(pairs: DataFrame) -> DataFrame:
    """The pairs whose coordinates nowhere differ by more than RADIUS."""
    apart = F.array_max(F.zip_with("x.coordinates", "y.coordinates", lambda a, b: F.abs(a - b)))
    return pairs.filter(apart <= RADIUS)


def lattice_links(crowded: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints by shared lattice points, each with the least of its point."""
    listed = crowded.select("fp", F.explode(lattice_points("fp")).alias("point"))
    return listed.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("point")).alias("b")).filter("a > b")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints (column fp) whose components are those of all pairs that link."""
    pairs, crowded = candidates(pivot_table(distinct))
    verified = survivors(pairs).filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
    close = verified.select(F.greatest("x.fp", "y.fp").alias("a"), F.least("x.fp", "y.fp").alias("b"))
    return close.unionByName(lattice_links(crowded)).distinct()


def components(edges: DataFrame, *, most: int = 60) -> DataFrame:
    """(node, root): for every node of edges (a, b), a > b, the least node that it reaches. Raises if `most` rounds don't do."""
    edges = written(edges, "links")
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = written(large, "stars")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a > b").distinct()
        small = written(small, "stars")
        # Stars are final when every node has one link only and no root is itself linked below.
        more = small.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        edges = small
        if not more:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def component_ids(marked: DataFrame, *, least: Column) -> DataFrame:
    """(fp, first): for every distinct fingerprint of `marked`, the least of `least` over its component."""
    own = written(marked.groupBy("fp").agg(F.min(least).alias("first")), "fingerprints")
    rooted = components(links(own))
    joined = written(rooted.join(own, F.col("node") == F.col("fp")).select("fp", "root", "first"), "rooted")
    best = joined.groupBy("root").agg(F.min("first").alias("best"))
    moved = joined.select("fp", "root").join(best, "root").select(F.col("fp").alias("f"), "best")
    return written(own.join(moved, F.col("fp") == F.col("f"), "left").select("fp", F.when(F.col("f").isNotNull(), F.col("best")).otherwise(F.col("first")).alias("first")), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    marked = written(with_fingerprints(docs, [F.col("doc_id")], "doc_id long"), "marked")
    first = component_ids(marked, least=F.col("doc_id"))
    return marked.join(first, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id (then of the least text hash).

    Where rows with this same id and text are repeated, the first by all other columns stays.
    """
    ident = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    marked = written(with_fingerprints(docs, ident, "doc_id long, text_hash long"), "marked")
    # Structs compare field by field; a null id comes last.
    first = component_ids(marked, least=F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash"), F.col("fp")))
    kept = written(first.select("first.*").distinct(), "kept").select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("unnamed").alias("__null"), F.col("text_hash").alias("__hash"))
    out = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__null": F.col("doc_id").isNull(), "__hash": F.xxhash64("text")}).join(kept, ["__id", "__null", "__hash"], "left_semi")
    repeated = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if repeated:  # only then does a kept row have others like it
        others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
        nth = F.row_number().over(Window.partitionBy("__id", "__null", "__hash").orderBy(others))
        out = out.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return out.drop("__id", "__null", "__hash")
