"""python -m scriptorium check [--json] [--infos] [--no-inputs] [--no-expand] [--color WHEN] [--stdin-filename NAME] PATH... | -

Exit status: 0 without errors, 1 with some, 2 where a path can't be read.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import diagnostics
from scriptorium.sources.documents import decoded, read_folder


def corpus(spark: SparkSession, paths: list[str], stdin_name: str) -> tuple[DataFrame | None, list[str]]:
    """Documents (doc_id, path, text) of folders, files or standard input, and the paths that can't be read."""
    if paths == ["-"]:
        raw = getattr(sys.stdin, "buffer", None)
        rows = spark.createDataFrame([(0, stdin_name, bytearray(raw.read() if raw else sys.stdin.read().encode()))], "doc_id long, path string, content binary")
        return rows.select("doc_id", "path", decoded(F.col("content")).alias("text")), []
    lost = [p for p in paths if not os.path.exists(p)]
    docs = None
    for p in paths:
        if p in lost:
            continue
        if os.path.isdir(p):
            one = read_folder(spark, p).select("doc_id", "path", "text")
        else:
            one = spark.read.format("binaryFile").load(p).select(F.xxhash64("path").alias("doc_id"), "path", decoded(F.col("content")).alias("text"))
        docs = one if docs is None else docs.unionByName(one)
    return (docs.dropDuplicates(["doc_id"]) if docs is not None else None), lost


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): the files of the folders given, and of those that the files given are in; contents are not read."""
    folders = sorted({p if os.path.isdir(p) else os.path.dirname(os.path.abspath(p)) for p in paths})
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check")
    check.add_argument("paths", nargs="+")
    for flag in ("--json", "--infos", "--no-inputs", "--no-expand"):
        check.add_argument(flag, action="store_true")
    check.add_argument("--stdin-filename", default=None)
    check.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    options = parser.parse_args(argv)
    if options.stdin_filename is not None and options.paths != ["-"]:
        parser.error("--stdin-filename goes with - only")
    color = options.color == "always" or (options.color == "auto" and sys.stdout.isatty())
    if "-" in options.paths and len(options.paths) > 1:
        parser.error("- must be alone")
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    docs, lost = corpus(spark, options.paths, options.stdin_filename or "<stdin>")
    for p in lost:
        print(f"{p}: can't be read", file=sys.stderr)
    counts = {}
    if docs is not None:
        docs = docs.cache()
        files = None if options.paths == ["-"] else manifest(spark, [p for p in options.paths if p not in lost])
        found = diagnostics.check(docs, files, expanded=not options.no_expand, follow_inputs=not options.no_inputs).cache()
        shown = found if options.infos else found.filter("severity <> 'info'")
        counts = {r["severity"]: r["n"] for r in diagnostics.summary(found).collect()}
        if options.json:
            # One at a time, so that the driver never holds all.
            rows = diagnostics.to_json(shown, docs, keep=("start", "stop", "code"), nulls=True).join(docs.select("doc_id", "path"), "doc_id").orderBy("path", "start", "stop", "code")
            print("[", end="")
            for k, r in enumerate(rows.toLocalIterator()):
                print(",\n" if k else "\n", r["json"], sep="", end="")
            print("\n]")
        else:
            rendered = diagnostics.render_text(shown, docs, color=color, fixes=True).join(docs.select("doc_id", "path"), "doc_id")
            for r in rendered.orderBy("path", "line", "col").toLocalIterator():
                print(f"{r['path']}:{r['rendered']}")
            hidden = 0 if options.infos else counts.get("info", 0)
            print(", ".join(f"{counts.get(s, 0)} {s}s" for s in ("error", "warning", "info")) + (f" ({hidden} not shown)" if hidden else ""))
        found.unpersist()
        docs.unpersist()
    return 2 if lost else int(bool(counts.get("error")))


if __name__ == "__main__":
    sys.exit(main())
