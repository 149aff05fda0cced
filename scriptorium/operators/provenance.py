"""Where what views show comes from: spans that grow to whole uses, regions of branches and categories, and views written back as sources.

All is told of `pieces` (a view is cut into pieces, each copied from a span of the source or written by a use) and `expansions`, by joins of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.kernel import USUAL
from scriptorium.operators.edits import rewrite
from scriptorium.operators.intervals import containing, last_before
from scriptorium.operators.nodes import parse
from scriptorium.tables import sorted_side, written


def pieces(views: DataFrame) -> DataFrame:
    """(doc_id, nth, start, stop, source, source_stop, exact): the pieces of views in order; exact ones are copied character by character."""
    return views.select("doc_id", F.posexplode("pieces").alias("nth", "p")).select("doc_id", "nth", "p.start", "p.stop", "p.source", "p.source_stop", F.col("p.expansion").isNull().alias("exact"))


def uses(views: DataFrame) -> DataFrame:
    """(doc_id, name, use, use_stop, outermost): the spans of uses in the source; those that stand in no other are outermost."""
    rows = views.select("doc_id", F.inline("expansions")).groupBy("doc_id", F.col("source").alias("use"), F.col("source_stop").alias("use_stop")).agg(F.min_by("name", "depth").alias("name"))
    before = Window.partitionBy("doc_id").orderBy("use", F.col("use_stop").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("outermost", F.coalesce(F.col("use_stop") > F.max("use_stop").over(before), F.lit(True)))


def source_spans(views: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (doc_id, start, stop, ...) of views with source_start and source_stop: the source of what each shows.

    Within one piece it is the piece's own text, or its use. Across several it is what covers all of them; a use whose arguments are copied in place
    is taken whole where the cover would cut it, or where its body writes them in another order, and that again until no use is cut.
    """
    keys = ["doc_id", "__start", "__stop"]
    asked = spans.select("doc_id", F.col("start").alias("__start"), F.col("stop").alias("__stop")).distinct()
    own = pieces(views)
    within = containing(own, asked, at="start", start="__start", stop="__stop")
    first = last_before(asked, own, at="__start", marked="start", mark="p").filter("p IS NOT NULL").select("doc_id", "__start", "__stop", "p.nth", "p.start", "p.stop", "p.source", "p.source_stop", "p.exact")
    columns = [*keys, "nth", "start", "stop", "source", "source_stop", "exact"]
    met = within.select(*columns).unionByName(first.select(*columns)).dropDuplicates([*keys, "nth"])
    # The part of an exact piece that the span shows; a use is shown whole.
    lo, hi = F.greatest("start", "__start"), F.least("stop", "__stop")
    met = met.withColumn("from", F.when(F.col("exact"), F.col("source") + lo - F.col("start")).otherwise(F.col("source"))).withColumn("to", F.when(F.col("exact"), F.col("source") + F.greatest(hi, lo) - F.col("start")).otherwise(F.col("source_stop")))
    order = Window.partitionBy(*keys).orderBy("nth")
    met = met.withColumn("back", F.coalesce(F.col("exact") & F.lag("exact").over(order) & (F.col("source") < F.lag("source_stop").over(order)), F.lit(False)))
    cover = met.groupBy(*keys).agg(F.min("from").alias("first"), F.max("to").alias("last"), F.count("*").alias("n"))
    # Uses in which some exact piece of the span is copied in place, and whether it goes back there.
    around = uses(views).select("doc_id", "use", "use_stop")
    held = containing(met.filter("exact").select(*keys, "from", "to", "back"), around, at="from", start="use", stop="use_stop").filter("to <= use_stop")
    listed = held.groupBy(*keys, "use", "use_stop").agg(F.max("back").alias("back")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("use", "use_stop", "back"))).alias("uses"))
    grown = cover.join(sorted_side(listed), keys, "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<struct<use:int,use_stop:int,back:boolean>>")))
    one = F.struct(F.col("first").alias("first"), F.col("last").alias("last"))

    def grow(acc: Column, u: Column) -> Column:
        cut = (u["use"] > acc["first"]) | (acc["last"] > u["use_stop"]) | u["back"]
        touched = (u["use"] < acc["last"]) & (acc["first"] < u["use_stop"])
        whole = cut & touched
        return F.struct(F.when(whole, F.least(acc["first"], u["use"])).otherwise(acc["first"]).alias("first"), F.when(whole, F.greatest(acc["last"], u["use_stop"])).otherwise(acc["last"]).alias("last"))

    # As many rounds as there are uses are enough: each that changes anything takes in one more.
    rounds = F.when(F.size("uses") > 0, F.sequence(F.lit(1), F.size("uses"))).otherwise(F.array().cast("array<int>"))
    end = F.when(F.col("n") > 1, F.aggregate(rounds, one, lambda acc, _: F.aggregate("uses", acc, grow))).otherwise(one)
    told = grown.withColumn("__end", end).select("doc_id", F.col("__start").alias("start"), F.col("__stop").alias("stop"), F.col("__end.first").alias("source_start"), F.when(F.col("__stop") > F.col("__start"), F.col("__end.last")).otherwise(F.col("__end.first")).alias("source_stop"))
    return spans.join(sorted_side(told), ["doc_id", "start", "stop"], "left")


def node_sources(views: DataFrame) -> DataFrame:
    """(doc_id, node_id, kind, name, content, start, stop, source_start, source_stop, source_text, origin): the nodes of views and what produced each.

    origin is the macro that wrote a node's beginning; null where it is copied from the source.
    """
    shown = written(parse(views.select("doc_id", F.col("view").alias("text"))).select("doc_id", F.inline("nodes")).filter("node_id > 0").select("doc_id", "node_id", "kind", "name", "content", "start", "stop"), "shown")  # read several times
    wrote = views.select("doc_id", F.inline(F.transform("pieces", lambda p: F.struct(p["start"].alias("at"), F.try_element_at("expansions", p["expansion"] + 1)["name"].alias("macro")))))
    told = last_before(source_spans(views, shown), wrote, at="start", marked="at", mark="__p")
    text = F.substr("text", F.col("source_start") + 1, F.col("source_stop") - F.col("source_start"))
    return told.join(sorted_side(views.select("doc_id", "text")), "doc_id").select("doc_id", "node_id", "kind", "name", "content", "start", "stop", "source_start", "source_stop", text.alias("source_text"), F.col("__p.macro").alias("origin"))


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, start, stop) with intervals that touch or overlap as one."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    new = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = rows.withColumn("__new", new.cast("int")).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__island")


def branch_regions(views: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, condition, second, taken, start, stop): what of each view comes from each branch of a conditional in its source.

    parsed is the reading of the sources. Pieces that overlap a branch are clipped to it and joined where they touch.
    """
    own = pieces(views).filter("source_stop > source OR NOT exact")
    branch = parsed.select("doc_id", F.inline("branches")).select("doc_id", "condition", "second", "taken", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    columns = ["doc_id", "condition", "second", "taken", "lo", "hi", "nth", "start", "stop", "source", "source_stop", "exact"]
    # A piece overlaps a branch where it begins in it, or the branch begins in the piece.
    one = containing(own, branch, at="source", start="lo", stop="hi")
    two = containing(branch, own.filter("exact").withColumn("__inner", F.col("source") + 1), at="lo", start="__inner", stop="source_stop")
    met = one.select(*columns).unionByName(two.select(*columns))
    begin = F.when(F.col("exact"), F.col("start") + F.greatest(F.col("lo") - F.col("source"), F.lit(0))).otherwise(F.col("start"))
    end = F.when(F.col("exact"), F.col("stop") - F.greatest(F.col("source_stop") - F.col("hi"), F.lit(0))).otherwise(F.col("stop"))
    rows = met.select("doc_id", "condition", F.col("second"), F.col("taken"), begin.alias("start"), end.alias("stop"))
    keyed = rows.withColumn("side", F.struct("condition", "second", "taken")).select("doc_id", "side", "start", "stop")
    return _islands(keyed, ["doc_id", "side"]).select("doc_id", "side.condition", "side.second", "side.taken", "start", "stop")


def categories_at(places: DataFrame, parsed: DataFrame) -> DataFrame:
    """places (doc_id, at, ...) with `table`, the categories that differ from the usual ones there, as a map of characters.

    A change holds from its place to the end of the group around it, or of the document where it is made for good; of several the last one holds.
    """
    groups = parsed.select("doc_id", F.inline("nodes")).filter(F.col("kind").isin("brace", "environment", "math", "option")).select("doc_id", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    at_sign = F.transform(F.filter("nodes", lambda n: (n["kind"] == "command") & n["name"].isin("makeatletter", "makeatother") & ~n["bare"]), lambda n: F.struct(n["start"].alias("start"), F.lit("@").alias("character"), F.when(n["name"] == "makeatletter", 11).otherwise(12).alias("category"), F.lit(False).alias("everywhere")))
    # Changes of @ by name may be among the changes already; the same said twice is the same.
    changed = parsed.select("doc_id", F.length("text").alias("size"), F.inline(F.concat("changes", at_sign))).withColumnRenamed("start", "since").dropDuplicates(["doc_id", "since", "character"])
    scoped = containing(changed.filter("NOT everywhere"), groups, at="since", start="lo", stop="hi").groupBy("doc_id", "since", "character").agg(F.max_by("hi", "lo").alias("until"))
    holds = changed.join(sorted_side(scoped), ["doc_id", "since", "character"], "left").select("doc_id", "character", "category", "since", F.coalesce("until", F.col("size") + 1).alias("until"))
    asked = places.select("doc_id", "at").distinct()
    met = containing(asked, holds, at="at", start="since", stop="until").groupBy("doc_id", "at", "character").agg(F.max_by("category", "since").alias("category"))
    known = F.create_map(*(F.lit(x) for pair in USUAL.items() for x in pair))
    usual = F.coalesce(F.try_element_at(known, F.col("character")), F.when(F.col("character").rlike("^[A-Za-z]$"), 11).otherwise(12))
    tables = met.filter(F.col("category") != usual).groupBy("doc_id", "at").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("character", "category")))).alias("table"))
    return places.join(sorted_side(tables), ["doc_id", "at"], "left").withColumn("table", F.coalesce("table", F.create_map().cast("map<string,int>")))


def category_regions(views: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, line, start, stop): what of each line of a view was written under other categories than hold where it is used.

    What a use writes has the categories of its macro's last definition before it; lines are those of the view.
    """
    made = parsed.select("doc_id", F.inline("definitions")).select("doc_id", "name", F.col("start").alias("at"))
    wrote = views.select("doc_id", "view", F.inline(F.transform(F.filter("pieces", lambda p: p["expansion"].isNotNull()), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["source"].alias("at"), F.try_element_at("expansions", p["expansion"] + 1)["name"].alias("name")))))
    own = last_before(wrote.drop("view"), categories_at(made, parsed).withColumnRenamed("at", "defined"), keys=("doc_id", "name"), at="at", marked="defined", mark="m").filter("m IS NOT NULL")
    here = categories_at(own.select("doc_id", "at", "start", "stop", F.col("m.table").alias("then")), parsed)
    entries = lambda c: F.array_sort(F.map_entries(c))
    foreign = _islands(here.filter(entries("table") != entries("then")).select("doc_id", "start", "stop"), ["doc_id"])
    # Line starts of the view, so that a region is cut where a line ends.
    text = views.select("doc_id", F.col("view").alias("text"))
    from scriptorium.operators.diagnostics import line_starts

    starts = line_starts(text).withColumn("until", F.coalesce(F.lead("first").over(Window.partitionBy("doc_id").orderBy("line")), F.lit(2**31)))
    first = last_before(foreign, starts, at="start", marked="first", mark="l").select("doc_id", "start", "stop", "l.line", "l.first", "l.until")
    later = containing(starts, foreign.withColumn("__inner", F.col("start") + 1), at="first", start="__inner", stop="stop").select("doc_id", "start", "stop", "line", "first", "until")
    return first.unionByName(later).select("doc_id", "line", F.greatest("start", "first").cast("int").alias("start"), F.least("stop", "until").cast("int").alias("stop"))


def compilable_edits(views: DataFrame, *, grouped: bool = True) -> DataFrame:
    """(doc_id, seq, start, stop, text): the least edits of sources that make them what their views show: one for each outermost use.

    grouped: what an environment wrote keeps to itself, as it did: its two ends open and close a group, which is neutral in text and in formulas.
    """
    outer = uses(views).filter("outermost").select("doc_id", "use", "use_stop")
    shown = containing(pieces(views).select("doc_id", "start", "stop", "source"), outer, at="source", start="use", stop="use_stop").groupBy("doc_id", "use", "use_stop").agg(F.min("start").alias("from"), F.max("stop").alias("to"))
    rows = outer.join(sorted_side(shown), ["doc_id", "use", "use_stop"], "left").join(sorted_side(views.select("doc_id", F.col("text").alias("__source"), "view")), "doc_id")
    said = F.coalesce(F.substr("view", F.col("from") + 1, F.col("to") - F.col("from")), F.lit(""))
    if grouped:
        used = F.substr("__source", F.col("use") + 1, F.col("use_stop") - F.col("use"))
        said = F.when(used.rlike(r"^\\begin\s*\{"), F.concat(F.lit("\\begingroup "), said)).when(used.rlike(r"^\\end\s*\{"), F.concat(said, F.lit("\\endgroup{}"))).otherwise(said)
    return rows.select("doc_id", F.col("use").alias("seq"), F.col("use").alias("start"), F.col("use_stop").alias("stop"), said.alias("text"))


def compilable(views: DataFrame, *, grouped: bool = True) -> DataFrame:
    """(doc_id, text): sources with all uses of their macros written out, and all else as it was, byte for byte."""
    return rewrite(views.select("doc_id", "text"), compilable_edits(views, grouped=grouped))
