"""Documents read together with the files that they include, so that definitions made there are known here.

Each file is scanned once for what it defines and includes. That list, not its text, goes to the documents that reach it, by resolved path.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import flatten, kernel
from scriptorium.functions.signatures import Table, builtin
from scriptorium.operators.nodes import per_document
from scriptorium.sources.documents import resolved
from scriptorium.tables import sorted_side, written

LEARNED = "doc_id long, path string, learned string, wanted array<struct<target:string,extension:string>>"


def package(path: str | None) -> bool:
    """Whether a file is read as a package or class, in which @ is a letter."""
    return path is not None and path.endswith((".sty", ".cls"))


STORED = "digest string, learned string, wanted array<struct<target:string,extension:string>>"
#: Of what is stored; another reading of files gets another number.
VERSION = 1


def digests(docs: DataFrame, table: Table | None = None) -> DataFrame:
    """docs with `digest`: of a file's text, of how it is read, and of the table of signatures."""
    t = table or builtin()
    signs = hashlib.sha256(repr([VERSION, sorted((n, repr(x)) for n, x in t.commands.items()), sorted((n, repr(x)) for n, x in t.environments.items())]).encode()).hexdigest()
    packaged = F.coalesce(F.col("path").rlike(r"\.(sty|cls)$"), F.lit(False)).cast("string")
    return docs.withColumn("digest", F.sha2(F.concat_ws("|", F.lit(signs), packaged, F.coalesce("text", F.lit(""))), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def files(docs: DataFrame, table: Table | None = None, store: str | None = None) -> DataFrame:
    """(doc_id, path, learned, wanted): what each file of docs (doc_id, path, text) defines for good, as JSON, and what it names.

    store: a folder in which what was learned outlives a run, by digest. Files whose digest is there are not read again, and each digest is read once;
    what is new is added.
    """

    def read(text: str, path: str | None) -> dict:
        items = kernel.learned(text, table, package=package(path))
        return {"learned": json.dumps(items), "wanted": [{"target": name, "extension": value} for where, name, value in items if where == "include"]}

    if store is None:
        return per_document(docs, LEARNED, lambda i, text, path: {"doc_id": i, "path": path} | read(text, path), "path")
    spark = docs.sparkSession
    named = digests(docs, table)
    known = spark.read.schema(STORED).parquet(store) if _exists(spark, store) else spark.createDataFrame([], STORED)
    new = named.join(sorted_side(known.select("digest")), "digest", "left_anti").dropDuplicates(["digest"])
    per_document(new, STORED, lambda i, text, path, digest: {"digest": digest} | read(text, path), "path", "digest").write.mode("append").parquet(store)
    # Two runs at once may have added the same digest.
    every = spark.read.schema(STORED).parquet(store).dropDuplicates(["digest"])
    return named.join(sorted_side(every), "digest").select(F.col("doc_id").cast("long"), "path", "learned", "wanted")


def edges(scanned: DataFrame) -> DataFrame:
    """(from_path, target, to_path): which file of files() each one names, by folder and extension."""
    named = scanned.select(F.col("path").alias("from_path"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.inline("wanted")).distinct()
    found = resolved(named, scanned.select("path"))
    return found.filter("path IS NOT NULL").select("from_path", "target", F.col("path").alias("to_path")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(root, to_path): all that each file includes, itself or through others, however long the chain; cycles end."""
    reach = written(edges.select(F.col("from_path").alias("root"), "to_path").distinct(), "reach")
    size = reach.count()
    while True:  # each round doubles the length of the chains that are followed
        step = reach.select(F.col("root").alias("f"), F.col("to_path").alias("p"))
        more = reach.select("root", F.col("to_path").alias("f")).join(sorted_side(step), "f").select("root", F.col("p").alias("to_path"))
        reach = written(reach.unionByName(more).distinct(), "reach")
        new = reach.count()
        if new == size:
            return reach
        size = new


def parse_together(docs: DataFrame, table: Table | None = None, *, expanded: bool = False, store: str | None = None) -> DataFrame:
    """parse() of docs (doc_id, path, text) in which each knows what its included files define, in the order of their inclusion. store: see files()."""
    scanned = written(files(docs, table, store), "files")
    named = written(edges(scanned), "edges")
    targets = named.groupBy("from_path").agg(F.map_from_entries(F.collect_list(F.struct("target", "to_path"))).alias("targets"))
    # A file without definitions and inclusions of its own has nothing to tell.
    told = scanned.filter("learned <> '[]'").select(F.col("path").alias("p"), "learned").join(sorted_side(targets), F.col("p") == F.col("from_path"), "left").select("p", "learned", "targets")
    reached = closure(named).join(sorted_side(told), F.col("to_path") == F.col("p")).groupBy("root").agg(F.collect_list(F.struct("p", "learned", "targets")).alias("files"))
    joined = docs.join(sorted_side(targets), F.col("path") == F.col("from_path"), "left").join(sorted_side(reached), F.col("path") == F.col("root"), "left").select("doc_id", "text", "path", "targets", "files")

    def one(doc_id, text: str, path: str | None, own, reach) -> dict:
        known = {r["p"]: {"targets": dict(r["targets"] or ()), "learned": json.loads(r["learned"])} for r in reach or ()}
        known.setdefault(path, {"learned": []})["targets"] = dict(own or ())
        return flatten.parsed(doc_id, text, table, package(path), files=known, path=path, expanded=expanded)

    return per_document(joined, flatten.PARSED, one, "path", "targets", "files")
