"""Documents: files of a folder, decoded; lines; master documents; resolution of names against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.tables import sorted_side


#: The extensions that an image may be named without.
IMAGES = (".pdf", ".png", ".jpg", ".jpeg", ".eps", ".mps")


def decoded(content: Column, encoding: str | None = None) -> Column:
    """UTF-8 where it is, without a byte-order mark; else Latin-1. A forced encoding that doesn't fit is an error."""
    if encoding is not None:
        if encoding.lower().replace("-", "") in ("utf8", "utf8sig"):
            wrong = F.raise_error(F.lit(f"a file is not {encoding}")).cast("string")
            return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(wrong), "^\ufeff", "")
        return F.regexp_replace(F.decode(content, encoding), "^\ufeff", "")
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def encoding_of(content: Column) -> Column:
    marked = F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF"))
    return F.when(~F.is_valid_utf8(content.cast("string")), "latin-1").when(marked, "utf-8-sig").otherwise("utf-8")


def read_folder(spark: SparkSession, path: str, glob: str = "*.tex", encoding: str | None = None) -> DataFrame:
    """(doc_id, path, name, encoding, text) of the files under a folder; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    raw = F.col("content")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), (F.lit(encoding) if encoding else encoding_of(raw)).alias("encoding"), decoded(raw, encoding).alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, eol): lines from 1, cut at \\n, \\r\\n and lone \\r only."""
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(cut).alias("n", "raw"))
    body = F.regexp_replace("raw", r"[\r\n]+$", "")
    return rows.select("doc_id", (F.col("n") + 1).cast("int").alias("line"), body.alias("text"), F.substr("raw", F.length(body) + 1).alias("eol"))


def master_names(docs: DataFrame) -> DataFrame:
    """(doc_id, root): the file named by `% !TEX root = x` in the first 20 lines."""
    named = lines(docs).filter("line <= 20").select("doc_id", "line", F.regexp_extract("text", r"(?i)^\s*%\s*!TEX\s+root\s*=\s*(.+?)\s*$", 1).alias("root")).filter("root <> ''")
    return named.groupBy("doc_id").agg(F.min_by("root", "line").alias("root"))


def masters(docs: DataFrame) -> DataFrame:
    """(doc_id, master_id, path): the master document of each that names one: it must exist among docs (doc_id, path, text) and be another."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    named = master_names(docs).join(sorted_side(docs.select("doc_id", folder.alias("folder"))), "doc_id").select("doc_id", "folder", F.col("root").alias("target"), F.lit(".tex").alias("extension"))
    found = resolved(named, docs.select("path")).filter("path IS NOT NULL").select("doc_id", "path")
    return found.join(sorted_side(docs.select(F.col("doc_id").alias("master_id"), "path")), "path").filter("doc_id <> master_id").select("doc_id", "master_id", "path")


def normalized(path: Column) -> Column:
    """A path without `.`, `x/..` and doubled slashes: its segments are folded, so any number of `..` is undone. Nothing is above a root."""
    root = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*:/*|/+)?", 0)
    rooted = root != ""
    back = lambda kept: (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("")) != "..")
    step = lambda kept, s: F.when(s.isin("", "."), kept).when(s != "..", F.concat(kept, F.array(s))).when(back(kept), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(rooted, kept).otherwise(F.concat(kept, F.array(s)))
    rest = F.array_join(F.aggregate(F.split(F.substr(path, F.length(root) + 1), "/"), F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(root.rlike("^/+$"), "/").otherwise(root), rest)


def tree_names(trees: DataFrame) -> DataFrame:
    """(name, rank, path): by each name that a file of trees (path, and rank, the tree's priority) can be asked for, the file that answers.

    A file answers to its name and to its name with any number of folders before it. Of several the tree with the least rank wins, then the first path.
    """
    rank = F.col("rank").cast("int") if "rank" in trees.columns else F.lit(0)
    parts = F.split("path", "/+")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    rows = trees.select("path", rank.alias("rank"), F.explode(F.array_distinct(names)).alias("name"))
    return rows.groupBy("name").agg(F.min(F.struct("rank", "path")).alias("best")).select("name", "best.rank", "best.path")


def resolved(inclusions: DataFrame, files: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """inclusions (doc_id, folder, target, extension, ...) with `path` of the manifest files (path), null where none fits.

    The target with its extension comes first; a .tex target may also be named barely, an image without its extension. What isn't found from the folder is
    looked for in `trees` (path, rank), the manifests of distributions in the order of their ranks, unless the target says where it is (an
    absolute path, `./` or `../`).
    """
    # One candidate a row, so that the manifests are met by equi-joins whatever their size.
    numbered = inclusions.withColumn("__row", F.monotonically_increasing_id())
    with_ext = F.when(F.col("extension") == "", F.col("target")).when(F.endswith("target", F.col("extension")), F.col("target")).otherwise(F.concat("target", "extension"))
    images = [F.when(F.col("extension") == "", F.concat("target", F.lit(e))).otherwise(with_ext) for e in IMAGES]
    options = F.array_distinct(F.array(with_ext, F.when(F.col("extension").isin(".tex", ""), F.col("target")).otherwise(with_ext), *images))
    base = F.when(F.startswith("target", F.lit("/")) | (F.coalesce("folder", F.lit("")) == ""), F.lit("")).otherwise(F.concat("folder", F.lit("/")))
    tried = numbered.select("*", F.posexplode(options).alias("__rank", "__name")).withColumn("__path", normalized(F.concat(base, F.col("__name"))))
    found = tried.join(sorted_side(files.select(F.col("path").alias("__found")).distinct()), F.col("__path") == F.col("__found"), "left")
    near = F.when(F.col("__found").isNotNull(), F.struct(F.lit(0).alias("far"), F.col("__rank").alias("nth"), F.lit(0).alias("tree"), F.col("__found").alias("path")))
    best = F.min(near)
    if trees is not None:
        far = tree_names(trees).select(F.col("name").alias("__asked"), F.col("rank").alias("__tree"), F.col("path").alias("__far"))
        asked = F.when(~F.col("target").rlike(r"^(/|\.\.?/|[A-Za-z][A-Za-z0-9+.-]*:/)"), normalized(F.col("__name")))
        found = found.withColumn("__asks", asked).join(sorted_side(far), F.col("__asks") == F.col("__asked"), "left")
        best = F.least(best, F.min(F.when(F.col("__far").isNotNull(), F.struct(F.lit(1).alias("far"), F.col("__rank").alias("nth"), F.col("__tree").alias("tree"), F.col("__far").alias("path")))))
    return found.groupBy("__row", *inclusions.columns).agg(best.alias("__best")).withColumn("path", F.col("__best.path")).drop("__row", "__best")
