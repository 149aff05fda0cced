"""Outlines: sections as blocks, counts of what each holds, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.intervals import containing, last_before
from scriptorium.operators.provenance import compilable_edits
from scriptorium.operators.tree import inner_text
from scriptorium.sources.documents import lines as lines_of
from scriptorium.tables import sorted_side

LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")


def _level(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), name).cast("int") - 1


def _is_heading(n: Column) -> Column:
    return (n["kind"] == "command") & n["base_name"].isin(*LEVELS) & ~n["bare"]


def headings(parsed: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, start, line, label, n, size): headings, with the numbers of nodes and characters of their documents; no row carries its document."""
    last = lambda n: F.try_element_at("nodes", F.element_at(F.filter(n["args"], lambda a: a.isNotNull()), -1) + 1)
    has = lambda n: F.coalesce(F.exists(n["args"], lambda a: a.isNotNull()), F.lit(False))
    told = F.transform(F.filter("nodes", _is_heading), lambda n: F.struct(n["node_id"].alias("node_id"), _level(n["base_name"]).alias("level"), n["start"].alias("start"), n["line"].alias("line"), F.when(has(n), inner_text("text", last(n))).alias("label")))
    return parsed.select("doc_id", F.size("nodes").alias("n"), F.length("text").alias("size"), F.inline(told))


def section_blocks(parsed: DataFrame) -> DataFrame:
    """(doc_id, block_id, parent_id, label, level, start, stop, line, until): a section lasts to the next of its level or above.

    until is the first node_id after the block. Sections inside other groups than the document count as well. Of each level the nearest heading before
    and after is a running value, so headings aren't compared with each other.
    """
    back = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc_id").orderBy(F.col("node_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct("node_id", "start")
    # Null for the highest level, above which there is nothing.
    above = F.array(*(F.last(F.when(F.col("level") < k, F.col("node_id")), ignorenulls=True).over(back) for k in range(len(LEVELS))))
    after = F.array(*(F.last(F.when(F.col("level") <= k, me), ignorenulls=True).over(ahead) for k in range(len(LEVELS))))
    rows = headings(parsed).withColumns({"__above": above, "__after": after})
    next_ = F.get("__after", F.col("level"))
    return rows.select("doc_id", F.col("node_id").alias("block_id"), F.get("__above", F.col("level")).alias("parent_id"), "label", "level", "start", F.coalesce(next_["start"], F.col("size")).alias("stop"), "line", F.coalesce(next_["node_id"], F.col("n")).alias("until"))


def blocks(parsed: DataFrame) -> DataFrame:
    """(doc_id, block_id, parent_id, what, label, level, start, stop, line, until): sections, and within them environments, displayed formulas,
    verbatim, commands over several lines and discarded branches. A block's parent is the nearest section or group that holds it.
    """
    sections = section_blocks(parsed).withColumn("what", F.lit("section"))
    long = lambda n: (n["kind"] == "command") & ~n["bare"] & F.coalesce(F.exists(n["args"], lambda a: F.try_element_at("nodes", a + 1)["end_line"] > n["line"]), F.lit(False)) & ~n["base_name"].isin(*LEVELS)
    shown = lambda n: (n["kind"].isin("environment", "verbatim") & (n["name"] != "document")) | ((n["kind"] == "math") & n["delimiter"].isin("\\[", "$$")) | long(n)
    what = F.when(F.col("kind") == "environment", F.when(F.col("mode") == "math", "math").otherwise("environment")).otherwise(F.col("kind"))
    groups = parsed.select("doc_id", F.inline(F.transform(F.filter("nodes", shown), lambda n: F.struct(n["node_id"].alias("block_id"), n["kind"].alias("kind"), n["mode"].alias("mode"), F.when(n["kind"] == "math", n["delimiter"]).otherwise(n["name"]).alias("label"), n["start"].alias("start"), n["stop"].alias("stop"), n["line"].alias("line"), (n["last"] + 1).alias("until"))))).withColumn("what", what)
    branches = parsed.select("doc_id", F.inline(F.transform(F.filter("branches", lambda b: b["taken"] == F.lit(False)), lambda b: F.struct(b["condition"].alias("block_id"), b["start"].alias("start"), b["stop"].alias("stop"), F.try_element_at("nodes", b["condition"] + 1)["line"].alias("line"), F.try_element_at("nodes", b["condition"] + 1)["name"].alias("label")))))
    branches = branches.withColumn("what", F.lit("discarded")).withColumn("until", F.col("block_id") + 1)
    columns = ["doc_id", "block_id", "what", "label", "start", "stop", "line", "until"]
    rows = sections.select(*columns, "level").unionByName(groups.select(*columns, F.lit(None).cast("int").alias("level"))).unionByName(branches.select(*columns, F.lit(None).cast("int").alias("level")))
    # The nearest block that opens before and closes after: of those whose nodes hold this one's first, the last.
    outer = rows.filter("what <> 'discarded'").select("doc_id", F.col("block_id").alias("outer"), (F.col("block_id") + 1).alias("__first"), F.col("until").alias("__stop"))
    held = containing(rows.select("doc_id", "block_id", "until"), outer, at="block_id", start="__first", stop="__stop").filter(F.col("__stop") >= F.col("until"))
    nearest = held.groupBy("doc_id", "block_id", "until").agg(F.max("outer").alias("parent_id"))
    return rows.join(sorted_side(nearest), ["doc_id", "block_id", "until"], "left").select("doc_id", "block_id", "parent_id", "what", "label", "level", "start", "stop", "line", "until")


def child_labels(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, label, n): how many of a block's children have each label: what a hidden block holds."""
    return blocks.filter("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("block_id"), "label").agg(F.count("*").alias("n"))


#: Commands that an outline tells of besides what they stand among. Fixed values.
NOTABLE = ("includegraphics", "input", "include", "label", "ref", "cite", "footnote", "caption", "item")


def block_stats(parsed: DataFrame, notable: tuple[str, ...] = NOTABLE) -> DataFrame:
    """(doc_id, block_id, key, n, first): words, formulas, environments, notable commands and discarded branches by the nearest section before them.

    Block 0 is what stands before any; `first` is where the key was first met. Commands are told as `\\name`, discarded branches as `discarded`.
    """
    words = lambda n: F.size(F.filter(F.split(n["content"], r"\s+"), lambda w: w != ""))
    prose = lambda n: F.coalesce((n["kind"] == "text") & (n["content"] != "") & (n["ctx"]["mode"] == "text") & n["ctx"]["arg_of"].isNull(), F.lit(False))
    command = lambda n: (n["kind"] == "command") & n["base_name"].isin(*notable) & ~n["bare"]
    key = lambda n: F.when(prose(n), "words").when(n["kind"] == "math", n["delimiter"]).when(n["kind"] == "environment", n["name"]).when(command(n), F.concat(F.lit("\\"), n["base_name"]))
    said = F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["start"].alias("first"), key(n).alias("key"), F.when(prose(n), words(n)).otherwise(1).alias("n")))
    gone = F.transform(F.filter("branches", lambda b: b["taken"] == F.lit(False)), lambda b: F.struct(b["condition"].alias("node_id"), b["start"].alias("first"), F.lit("discarded").alias("key"), F.lit(1).alias("n")))
    rows = parsed.select("doc_id", F.inline(F.concat(F.filter(said, lambda x: x["key"].isNotNull()), gone)))
    heads = parsed.select("doc_id", F.explode(F.transform(F.filter("nodes", _is_heading), lambda n: n["node_id"])).alias("block_id"))
    own = last_before(rows, heads, at="node_id", marked="block_id", mark="__head")
    return own.groupBy("doc_id", F.coalesce("__head.block_id", F.lit(0)).alias("block_id"), "key").agg(F.sum("n").cast("long").alias("n"), F.min("first").alias("first"))


def rolled_up(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, block_id, key, n): counts of a block with all the blocks below it, by intervals of node numbers."""
    outer = blocks.select("doc_id", F.col("block_id").alias("__block"), F.col("until").alias("__until"))
    met = containing(stats.select("doc_id", F.col("block_id").alias("__at"), "key", "n"), outer, at="__at", start="__block", stop="__until")
    return met.groupBy("doc_id", F.col("__block").alias("block_id"), "key").agg(F.sum("n").alias("n"))


def top_stats(stats: DataFrame, k: int = 3) -> DataFrame:
    """Words, then the k most common others of each block; of equals the first seen (column `first`, where stats has it), then by key."""
    order = [(F.col("key") != "words"), F.col("n").desc(), *([F.col("first")] if "first" in stats.columns else []), F.col("key")]
    nth = F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy(*order))
    return stats.withColumn("nth", nth).filter(F.col("nth") <= k + 1)


def runs(blocks: DataFrame) -> DataFrame:
    """(doc_id, parent_id, label, first, n): neighbours with one label together, as gaps and islands."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("block_id")
    new = F.when(F.lag("label").over(order).eqNullSafe(F.col("label")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = blocks.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    return marked.groupBy("doc_id", "parent_id", "island", "label").agg(F.min("block_id").alias("first"), F.count("*").alias("n")).drop("island")


def outline(blocks: DataFrame, stats: DataFrame, *, depth: int | None = None, width: int | None = None, grouped: bool = False) -> DataFrame:
    """(doc_id, outline): each document's sections, indented by level, with their numbers of words.

    depth: levels below it are left out; width: longer lines end in an ellipsis; grouped: equal neighbours without words of their own that
    follow each other are one line with their number.
    """
    own = stats.filter("key = 'words'").select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), F.col("n").alias("words"))
    rows = blocks.join(sorted_side(own), (F.col("doc_id") == F.col("d")) & (F.col("block_id") == F.col("b")), "left")
    if depth is not None:
        rows = rows.filter(F.col("level") <= depth)
    rows = rows.withColumn("words", F.coalesce("words", F.lit(0))).withColumn("times", F.lit(1))
    if grouped:
        order = Window.partitionBy("doc_id").orderBy("block_id")
        same = F.lag(F.struct("parent_id", "level", "label", "words")).over(order).eqNullSafe(F.struct("parent_id", "level", "label", "words"))
        rows = rows.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(order))
        rows = rows.groupBy("doc_id", "island", "level", "label", "words").agg(F.min("block_id").alias("block_id"), F.count("*").alias("times"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.coalesce("label", F.lit("")), F.lit(" ("), F.col("words").cast("string"), F.lit(" words)"), F.when(F.col("times") > 1, F.concat(F.lit(" ×"), F.col("times").cast("string"))).otherwise(""))
    if width is not None:
        line = F.when(F.length(line) > width, F.concat(F.substr(line, F.lit(1), F.lit(width - 1)), F.lit("…"))).otherwise(line)
    listed = rows.select("doc_id", F.struct("block_id", line.alias("t")).alias("x"))
    return listed.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("outline"))


def html_page(docs: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page): a document as a page of its own: its outline on one side, its source with marked diagnostics on the other."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    said = found.groupBy("doc_id", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "stop", "severity", "message"))), lambda x: F.concat(F.lit('<span class="'), x["severity"], F.lit('">'), escaped(x["message"]), F.lit("</span>"))), "").alias("notes"))
    source = lines_of(docs).join(sorted_side(said), ["doc_id", "line"], "left").select("doc_id", F.struct("line", F.concat(F.lit('<li id="l'), F.col("line").cast("string"), F.lit('">'), escaped(F.col("text")), F.coalesce("notes", F.lit("")), F.lit("</li>")).alias("t")).alias("x"))
    body = source.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("source"))
    item = F.concat(F.lit('<li class="level'), F.coalesce("level", F.lit(9)).cast("string"), F.lit('"><a href="#l'), F.col("line").cast("string"), F.lit('">'), escaped(F.coalesce("label", F.lit(""))), F.lit("</a></li>"))
    nav = blocks.select("doc_id", F.struct("block_id", item.alias("t")).alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("nav"))
    joined = docs.select("doc_id").join(sorted_side(body), "doc_id", "left").join(sorted_side(nav), "doc_id", "left")
    return joined.select("doc_id", F.concat(F.lit("<!doctype html><meta charset=utf-8><nav><ul>\n"), F.coalesce("nav", F.lit("")), F.lit("\n</ul></nav><main><ol>\n"), F.coalesce("source", F.lit("")), F.lit("\n</ol></main>")).alias("page"))


#: A check box shows one face or the other, without a script.
FACES = "#face:checked~main .source,#face:not(:checked)~main .shown{display:none}"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def two_faces(views: DataFrame) -> DataFrame:
    """(doc_id, faces): sources in which each outermost use of a macro also carries what it becomes, as HTML."""
    made = compilable_edits(views, grouped=False).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "text"))).alias("uses"))
    rows = views.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sorted_side(made), "doc_id", "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<struct<start:int,stop:int,text:string>>")))
    span = lambda a, b: _escaped(F.substr("text", a + 1, b - a))
    stops = F.concat(F.array(F.lit(0)), F.transform("uses", lambda u: u["stop"]))
    one = lambda u, before: F.concat(span(before, u["start"]), F.lit('<span class="source">'), span(u["start"], u["stop"]), F.lit('</span><span class="shown">'), _escaped(u["text"]), F.lit("</span>"))
    parts = F.zip_with("uses", F.slice(stops, F.lit(1), F.size("uses")), one)
    return rows.select("doc_id", F.concat(F.array_join(parts, ""), span(F.element_at(stops, -1), F.length("text"))).alias("faces"))


def faces_page(views: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page): a page of its own with a document's outline and its text, as written or as its macros make it: a check box turns it over."""
    item = F.concat(F.lit('<li class="level'), F.coalesce("level", F.lit(9)).cast("string"), F.lit('">'), _escaped(F.coalesce("label", F.lit(""))), F.lit("</li>"))
    nav = blocks.select("doc_id", F.struct("block_id", item.alias("t")).alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("nav"))
    joined = two_faces(views).join(sorted_side(nav), "doc_id", "left")
    head = f"<!doctype html><meta charset=utf-8><style>{FACES}</style><input type=checkbox id=face><label for=face>expanded</label><nav><ul>\n"
    return joined.select("doc_id", F.concat(F.lit(head), F.coalesce("nav", F.lit("")), F.lit("\n</ul></nav><main><pre>"), "faces", F.lit("</pre></main>")).alias("page"))


def environments_counted(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin("environment", "verbatim")).groupBy("name").agg(F.count("*").alias("n"))
