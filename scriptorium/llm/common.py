"""Helpers shared by the operators: scratch tables, hold-out rules, Arrow text maps, labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/scriptorium"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = named or LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a table in the shared folder: computed once, and recoverable without its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or a plain local path, and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def held_out(id_col: str, mod: int, rem: int) -> Column:
    """Whether an id is held out from learning; a null id is not."""
    return F.coalesce(remainder(id_col, mod) == rem, F.lit(False))


def learnable(id_col: str, mod: int, rem: int) -> Column:
    """Whether a row may be learned from; never where the id is null."""
    return F.coalesce(remainder(id_col, mod) != rem, F.lit(False))


def map_text(df: DataFrame, keep: list[Column], text: Column, score: Callable[[list], dict[str, pa.Array]], schema: str) -> DataFrame:
    """The kept columns and what `score` makes of each batch's whole texts (None where null), through Arrow.

    `score` gets a list of str and returns new columns by name; `schema` is the DDL of kept and new columns.
    """
    ship(df.sparkSession)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = score(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *new.values()], names=[*b.schema.names[:n], *new])

    return df.select(*keep, text.cast("string").alias("__text")).mapInArrow(run, schema)


def filter_text(df: DataFrame, text_col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df whose whole texts `keep` accepts, a batch at a time, with all columns as they are."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rem: int, *, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most `per_class` labelled texts of each class 0 and 1, chosen by a hash of their id, for fitting on the driver.

    Rows whose crc32 remainder is `rem`, or whose label or id is null, are never taken; null texts and those over `max_chars`
    characters are passed over before any is chosen, so that the sample has at most 2 * per_class * max_chars characters and a class has
    as many texts as it can.
    """
    ok = labels.filter(learnable("doc_id", mod, rem)).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
    short = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text")).filter(F.length("__text") <= max_chars)
    known = ok.filter("__label IN (0, 1)").join(short.select("__id"), "__id", "left_semi").distinct()
    order = [F.xxhash64("__id"), F.col("__id")]
    ids = None
    for value in (0, 1):
        part = known.filter(F.col("__label") == value).orderBy(*order).limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # At most 2 * per_class rows of two numbers are broadcast.
    rows = short.join(F.broadcast(ids), "__id").select("__id", "__text", "__label").distinct().orderBy(*order, "__label", "__text").limit(2 * per_class).collect()
    return [(r["__text"], r["__label"]) for r in rows]
