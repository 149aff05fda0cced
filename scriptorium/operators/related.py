"""Related places of diagnostics: the opening, the first of two, or what stands in the way, told beside what is wrong.

A document's reports and what could explain them leave its row as two small arrays. Openings are met by intervals (the nearest that holds the report's
place), earlier things by an ordered pass (the last before it), both keyed by document and kind, so a report is never compared with all nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.flatten import BOXES
from scriptorium.functions.signatures import ALIGNMENTS, MATH_ENVIRONMENTS, TABLES
from scriptorium.operators.intervals import containing, last_before
from scriptorium.tables import sorted_side

PLACE = "array<struct<start:int,stop:int,line:int,col:int,end_line:int,end_col:int,message:string>>"
#: Of each code, what encloses its place and is told, and how.
OPENED = {
    "display-in-math": ("math", "the formula is opened here"), "invalid-in-math": ("math", "the formula is opened here"), "blank-line-in-math": ("math", "the formula is opened here"), "dollar-in-math": ("math", "the formula is opened here"),
    "math-in-math": ("math", "the formula is opened here"), "tag-not-allowed": ("math", "the formula is opened here"), "item-outside-list": ("environment", "the environment here is no list"), "ampersand-outside-alignment": ("environment", "the environment here aligns nothing"),
    "crossed-environment": ("environment", "the environment is opened here"), "too-many-columns": ("table", "the columns are set here"), "left-across-cells": ("table", "the alignment is opened here"), "float-in-box": ("box", "the box is here"),
    "blank-line-in-argument": ("owner", "the argument belongs to this command"), "verb-in-argument": ("owner", "the argument belongs to this command"), "left-without-right": ("end", "the group ends here"),
}
#: Of each code, what was before its place and is told, and how. `define` goes by name.
EARLIER = {"multiple-labels": ("label", "the first label is here"), "multiple-tags": ("tag", "the first tag is here"), "line-break-without-line": ("par", "the paragraph ends here"), "ambiguous-fraction": ("fraction", "the first fraction is here"), "already-defined": ("define", "the first definition is here")}
FRACTIONS = ("over", "atop", "above", "choose", "brack", "brace")


def _mark(key: Column | str, first: Column, until: Column, start: Column, size: Column, line: Column, col: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), first.cast("int").alias("first"), until.cast("int").alias("until"), start.cast("int").alias("start"), size.cast("int").alias("size"), line.cast("int").alias("line"), col.cast("int").alias("col"))


def marks(shorts: tuple[str, ...]) -> Column:
    """What could explain a report of a parsed document, as an array: an interval that holds places, or a place before them (until is null then)."""
    environment, math, command = (lambda n: n["kind"] == "environment"), (lambda n: n["kind"] == "math"), (lambda n: (n["kind"] == "command") & ~n["bare"])
    opening = lambda n: F.when(math(n), F.length(n["delimiter"])).otherwise(F.length(n["name"]) + 8)
    held = lambda key, n: _mark(key, n["start"] + 1, n["stop"], n["start"], opening(n), n["line"], n["col"])
    before = lambda key, n: _mark(key, n["start"], F.lit(None), n["start"], n["stop"] - n["start"], n["line"], n["col"])
    closing = lambda n: F.when(math(n), F.length(n["delimiter"])).when(environment(n), F.length(n["name"]) + 6).otherwise(1)
    arguments = lambda key, n: F.transform(F.filter(n["args"], lambda a: a.isNotNull()), lambda a: _mark(key, F.try_element_at("nodes", a + 1)["start"] + 1, F.try_element_at("nodes", a + 1)["stop"], n["start"], n["stop"] - n["start"], n["line"], n["col"]))
    none = F.array().cast("array<struct<key:string,first:int,until:int,start:int,size:int,line:int,col:int>>")
    some = lambda when, what: F.when(when, what)

    def of(n: Column) -> Column:
        one = F.array_compact(F.array(
            some(math(n) | (environment(n) & n["name"].isin(*sorted(MATH_ENVIRONMENTS))), held("math", n)), some(environment(n) & (n["name"] != "document"), held("environment", n)), some(environment(n) & n["name"].isin(*sorted(ALIGNMENTS)), held("table", n)),
            some(environment(n) & n["name"].isin("minipage", *sorted(TABLES)), held("box", n)), some(n["kind"].isin("math", "brace", "environment"), _mark("end", n["start"] + 1, n["stop"], n["stop"] - closing(n), closing(n), n["end_line"], n["end_col"] - closing(n))),
            some(command(n) & n["base_name"].isin("label", "tag") & (n["place"]["nth"] == 1), before(n["base_name"], n)), some((n["kind"] == "text") & (n["content"] == ""), before("par", n)), some(command(n) & n["name"].isin(*FRACTIONS), before("fraction", n)),
        ))
        return F.concat(one, F.coalesce(F.when(command(n) & n["base_name"].isin(*sorted(BOXES)), arguments("box", n)), none), F.coalesce(F.when(command(n) & n["base_name"].isin(*shorts), arguments("owner", n)), none))

    defined = F.transform("definitions", lambda d: _mark(F.concat(F.lit("define:"), d["name"]), d["start"], F.lit(None), d["start"], d["stop"] - d["start"], d["line"], d["col"]))
    return F.concat(F.flatten(F.transform("nodes", of)), defined)


def _map(d: dict[str, tuple[str, str]], k: int) -> Column:
    return F.create_map(*(F.lit(x) for code, pair in d.items() for x in (code, pair[k])))


def _key(d: dict[str, tuple[str, str]], code: Column, message: Column) -> Column:
    """What explains a report, by its code; null where nothing does."""
    key = F.try_element_at(_map(d, 0), code)
    return F.when(key == "define", F.concat(F.lit("define:"), F.regexp_extract(message, r"^\\?(\S+) is already", 1))).otherwise(key)


def asked(found: Column) -> Column:
    """The keys of what could explain a document's reports."""
    return F.array_compact(F.transform(found, lambda r: _key(OPENED | EARLIER, r["code"], r["message"])))


def asked_marks(keys: str, shorts: tuple[str, ...]) -> Column:
    """marks() of the keys in a column, null where there are none: what no report asks for doesn't leave its row."""
    return F.when(F.size(keys) > 0, F.filter(marks(shorts), lambda m: F.array_contains(keys, m["key"])))


def with_related(kept: DataFrame) -> DataFrame:
    """(doc_id, all of a report, related) of kept (doc_id, found, marks), a table that is read several times: each report with the places that explain it."""
    rows = kept.select("doc_id", F.posexplode("found").alias("__nth", "r"))
    said = _map(OPENED | EARLIER, 1)
    place = lambda d: rows.select("doc_id", "__nth", F.col("r.start").alias("__at"), F.col("r.code").alias("__code"), _key(d, F.col("r.code"), F.col("r.message")).alias("key")).filter("key IS NOT NULL")
    inside, after = place(OPENED), place(EARLIER)
    every = kept.select("doc_id", F.inline("marks"))
    held = containing(inside, every.filter("until IS NOT NULL"), keys=("doc_id", "key"), at="__at", start="first", stop="until")
    nearest = held.groupBy("doc_id", "__nth", "__code").agg(F.max(F.struct("first", "start", "size", "line", "col")).alias("m")).select("doc_id", "__nth", "__code", "m.start", "m.size", "m.line", "m.col")
    last = last_before(after, every.filter("until IS NULL"), keys=("doc_id", "key"), at="__at", marked="first", mark="m", inclusive=False).filter("m IS NOT NULL").select("doc_id", "__nth", "__code", "m.start", "m.size", "m.line", "m.col")
    one = F.struct("start", (F.col("start") + F.col("size")).alias("stop"), "line", "col", F.col("line").alias("end_line"), (F.col("col") + F.col("size")).alias("end_col"), F.try_element_at(said, F.col("__code")).alias("message"))
    found = nearest.unionByName(last).groupBy("doc_id", "__nth").agg(F.sort_array(F.collect_list(one)).cast(PLACE).alias("related"))
    return rows.join(sorted_side(found), ["doc_id", "__nth"], "left").select("doc_id", "r.*", F.coalesce("related", F.array().cast(PLACE)).alias("related"))


def lines_of_related(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, __lines): the lines (doc_id, line, text) that related places are on, of each document, by number."""
    wanted = found.select("doc_id", F.explode(F.transform("related", lambda r: r["line"])).alias("line")).distinct()
    return wanted.join(sorted_side(lines.select("doc_id", "line", "text")), ["doc_id", "line"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "text"))).alias("__lines"))
