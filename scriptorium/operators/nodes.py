"""The scan of documents as tables: nodes, events, definitions, inclusions, views, prose."""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.functions import expand as expansion
from scriptorium.functions import flatten, typeset
from scriptorium.functions.kernel import USUAL, scan, walk
from scriptorium.functions.signatures import Table
from scriptorium.session import ship
from scriptorium.tables import written

#: Documents and characters of an output batch; they bound a worker's memory, not what is read.
BATCH, CHARACTERS = 1024, 1 << 15
VIEW = "doc_id long, text string, view string, pieces array<struct<start:int,stop:int,source:int,source_stop:int,expansion:int,depth:int>>, expansions array<struct<expansion_id:int,parent_id:int,name:string,source:int,source_stop:int,depth:int>>"
PROSE = "doc_id long, prose string, marks array<struct<at:int,length:int,node_id:int,start:int,stop:int,faithful:boolean>>"


def collect_seldom() -> None:
    """Trees hold no cycles and go when they are done with, so a worker need not look for cycles after every few nodes."""
    gc.freeze()
    gc.set_threshold(100_000, 20, 20)


def stretches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches [at, until) of BATCH documents or CHARACTERS characters; a longer document is a stretch of its own."""
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and (k - at == BATCH or size + len(t or "") > CHARACTERS):
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def per_document(docs: DataFrame, schema: str, one, *more: str) -> DataFrame:
    """The rows that `one(doc_id, text, ...)` makes, a document at a time; a null text is empty. more: further columns it gets."""
    ship(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collect_seldom()
        for b in batches:
            ids, texts, *rest = (c.to_pylist() for c in b.columns)
            for at, until in stretches(texts):
                yield pa.RecordBatch.from_pylist([one(i, t or "", *x) for i, t, *x in zip(*(c[at:until] for c in (ids, texts, *rest)), strict=True)], arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(run, schema)


def parse(docs: DataFrame, table: Table | None = None, *, package: bool = False, expanded: bool = False) -> DataFrame:
    """One row a document (doc_id, text): text, fragment, and its nodes, events, definitions, inclusions and more as arrays.

    expanded: of the document with its macros expanded, all places told of the source, and `by` the macro that wrote there.
    """
    return per_document(docs, flatten.PARSED, lambda i, t: flatten.parsed(i, t, table, package, expanded=expanded))


def plain(docs: DataFrame, *columns: str, table: Table | None = None) -> DataFrame:
    """(doc_id, text, nodes): parse() with these columns of nodes only (of flatten.PLAIN_NODE), for what asks for no more.

    A worker makes and hands on what is asked for, column by column; the scan is the same.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, text string, nodes array<struct<" + ",".join(flatten.PLAIN_NODE[c].replace(" ", ":") for c in columns) + ">>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    of_nodes = arrow.field("nodes").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collect_seldom()
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, until in stretches(texts):
                out: dict[str, list] = {c: [] for c in columns}
                ends = list(itertools.accumulate((flatten.plain_rows(scan(t or "", table), out) for t in texts[at:until]), initial=0))
                made = pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in of_nodes.value_type], fields=list(of_nodes.value_type))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, until - at), pa.array([t or "" for t in texts[at:until]], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, type=of_nodes)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def parse_once(docs: DataFrame, table: Table | None = None, *, package: bool = False, expanded: bool = False) -> DataFrame:
    """parse() through a table in the shared folder, for what reads it several times: each document is scanned once, at once."""
    return written(parse(docs, table, package=package, expanded=expanded), "parsed")


def nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("nodes"))


def events(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("events"))


def definitions(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("definitions"))


def branches(parsed: DataFrame) -> DataFrame:
    """(doc_id, condition, start, stop, second, taken): the branches of conditionals; taken is null where the condition isn't known."""
    return parsed.select("doc_id", F.inline("branches"))


def changes(parsed: DataFrame) -> DataFrame:
    """(doc_id, start, character, category, everywhere): assignments of category codes, in order."""
    return parsed.select("doc_id", F.inline("changes"))


def with_categories(changed: DataFrame, base: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, categories): a fixed table of characters' categories, by default the usual one, as each document's changes leave it."""
    known = F.create_map(*(F.lit(x) for pair in (base or USUAL).items() for x in pair))
    last = changed.groupBy("doc_id", "character").agg(F.max_by("category", "start").alias("category")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("character", "category")))).alias("own"))
    over = lambda m: F.map_filter(known, lambda k, v: ~F.map_contains_key(m, k))
    return last.select("doc_id", F.map_concat(over(F.col("own")), "own").alias("categories"))


def differences(categories: DataFrame, base: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, character, before, after): where a document's categories differ from a fixed table."""
    known = F.create_map(*(F.lit(x) for pair in (base or USUAL).items() for x in pair))
    rows = categories.select("doc_id", F.explode("categories").alias("character", "after")).withColumn("before", F.try_element_at(known, F.col("character")))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after"))).select("doc_id", "character", "before", "after")


def inclusions(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("inclusions"))


def views(docs: DataFrame, table: Table | None = None, *, depth: int = expansion.DEPTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: its text with macros expanded, the source of each piece, and the expansions."""
    kept = frozenset(keep)

    def one(doc_id, text: str) -> dict:
        view, pieces, made = expansion.expand(text, table, depth=depth, keep=kept)
        return {"doc_id": doc_id, "text": text, "view": view, "pieces": [vars(p) for p in pieces], "expansions": made}

    return per_document(docs, VIEW, one)


def views_once(docs: DataFrame, table: Table | None = None, **how) -> DataFrame:
    """views() through a table in the shared folder, for what reads them several times: each document is expanded once, at once."""
    return written(views(docs, table, **how), "views")


def prose(docs: DataFrame, table: Table | None = None, *, math: str = "source") -> DataFrame:
    """One row a document: what it reads like, and marks of where each stretch comes from."""

    def one(doc_id, text: str) -> dict:
        s = scan(text, table)
        order = [n for n, *_ in walk(s.root)]
        said, marks = typeset.prose(s, math)
        out = []
        for at, length, k in marks:
            n = order[k]
            out.append({"at": at, "length": length, "node_id": k, "start": n.start, "stop": n.end, "faithful": s.text[n.start : n.start + length] == said[at : at + length]})
        return {"doc_id": doc_id, "prose": said, "marks": out}

    return per_document(docs, PROSE, one)


def search(said: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, nth, hit, at, node_id, source): every match of a Java regular expression in prose, with its place in the source.

    Places are running sums over matches, and marks are met by an as-of join: the last one at or before a match, by a window over both.
    """
    hits = F.regexp_extract_all("prose", F.lit(pattern), F.lit(0))
    empty = F.raise_error(F.lit("the pattern matches the empty string")).cast("array<string>")
    # What stands before each match, and the matches; the pattern has no group of ours around it, so its own references hold.
    pieces = said.select("doc_id", F.split("prose", pattern, -1).alias("gaps"), hits.alias("hits")).select("doc_id", "gaps", F.when(F.array_contains("hits", ""), empty).otherwise(F.col("hits")).alias("hits"))
    rows = pieces.select("doc_id", F.posexplode(F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), "hits", lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))).alias("k", "x"))
    order = Window.partitionBy("doc_id").orderBy("k")
    hits = rows.select("doc_id", (F.col("k") + 1).alias("nth"), "x.hit", (F.sum(F.col("x.gap") + F.length("x.hit")).over(order) - F.length("x.hit")).cast("int").alias("at"))
    none = F.lit(None)
    marks = said.select("doc_id", F.inline("marks"))
    both = hits.select("doc_id", "at", "nth", "hit", none.cast("struct<at:int,node_id:int,start:int,faithful:boolean>").alias("m")).unionByName(marks.select("doc_id", "at", none.cast("int").alias("nth"), none.cast("string").alias("hit"), F.struct("at", "node_id", "start", "faithful").alias("m")))
    upto = Window.partitionBy("doc_id").orderBy("at", F.col("nth").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("m", F.last("m", ignorenulls=True).over(upto)).filter("nth IS NOT NULL")
    return found.select("doc_id", "nth", "hit", "at", F.col("m.node_id").alias("node_id"), F.when(F.col("m.faithful"), F.col("m.start") + F.col("at") - F.col("m.at")).otherwise(F.col("m.start")).alias("source"))
