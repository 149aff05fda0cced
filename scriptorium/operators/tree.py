"""Queries over the node table: predicates, arguments, segments, preamble, lines. Siblings are windows, ancestors ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.folds import content_hashes
from scriptorium.operators.intervals import containing
from scriptorium.sources.documents import lines as lines_of
from scriptorium.tables import sorted_side

GRAPHICS = ("includegraphics", "input@graphics", "epsfig", "includesvg")


def siblings():
    """The window over a node's siblings in order."""
    return Window.partitionBy("doc_id", "parent_id").orderBy("sib")


def is_command(*names: str) -> Column:
    return (F.col("kind") == "command") & F.col("name").isin(*names)


def is_env(name: str) -> Column:
    """`$` stands for any formula."""
    if name == "$":
        return F.col("kind") == "math"
    return (F.col("kind").isin("environment", "verbatim")) & (F.col("name") == name)


def child(nodes: DataFrame, *path: int) -> DataFrame:
    """(doc_id, node_id, ...): the node of each document at a path of places among siblings, from the root; negative places count from the end."""
    at = nodes.filter("parent_id IS NULL")
    for place in path:
        own = nodes.join(sorted_side(at.select("doc_id", F.col("node_id").alias("parent_id"))), ["doc_id", "parent_id"], "left_semi")
        if place < 0:
            own = own.withColumn("__from_end", F.col("sib") - F.max("sib").over(Window.partitionBy("doc_id", "parent_id")) - 1)
            at = own.filter(F.col("__from_end") == place).drop("__from_end")
        else:
            at = own.filter(F.col("sib") == place)
    return at


def is_par() -> Column:
    return (F.col("kind") == "text") & (F.col("content") == "")


def inside(node: str, outer: str) -> Column:
    """Nested sets: whether the node of alias `node` is within that of alias `outer` (of the same document)."""
    return (F.col(f"{node}.node_id") > F.col(f"{outer}.node_id")) & (F.col(f"{node}.node_id") <= F.col(f"{outer}.last"))


def raw_text(text: str = "text", start: str = "start", stop: str = "stop") -> Column:
    return F.substr(text, F.col(start) + 1, F.col(stop) - F.col(start))


def commands_arguments(parsed: DataFrame, names: list[str], *, nargs: int | None = None, nopt: int | None = None, starred: bool = True) -> DataFrame:
    """(doc_id, node_id, name, nth, arg_id, arg_kind, start, stop, inner_start, inner_stop, line, col): each occurrence and its arguments.

    nth 0 is the command. By its signature, or where nargs or nopt are given: up to nopt options present, then the next nargs
    (one by default) siblings; a bare command stands alone. Documents are read once: arguments by signature are in the row, siblings in a window.
    """
    wanted = list(names) + ([f"{n}*" for n in names] if starred else [])
    shown = ("node_id", "kind", "start", "stop", "inner_start", "inner_stop", "line", "col")
    own = lambda n: F.struct(*(n[c].alias(c) for c in shown))
    is_it = lambda n: (n["kind"] == "command") & n["name"].isin(wanted)
    by_hand = nargs is not None or nopt is not None
    known = lambda n: F.lit(None) if by_hand else F.when(n["spec"].isNotNull(), F.transform(F.coalesce(n["args"], F.array().cast("array<int>")), lambda a: F.when(a.isNotNull(), own(F.try_element_at("nodes", a + 1)))))
    none_type = "array<struct<node_id:int,kind:string,start:int,stop:int,inner_start:int,inner_stop:int,line:int,col:int>>"
    row = lambda n: F.struct(n["parent_id"].alias("parent_id"), n["sib"].alias("sib"), n["name"].alias("name"), n["bare"].alias("bare"), is_it(n).alias("__is"), own(n).alias("own"), F.when(is_it(n), known(n)).cast(none_type).alias("known"))
    # Where no signature tells, only the next `most` siblings that are no comments can be meant.
    most = (nopt or 0) + (nargs if nargs is not None else 1)
    rows = parsed.select("doc_id", F.inline(F.transform(F.filter("nodes", lambda n: n["kind"] != "comment"), row)))
    if most:
        after = Window.partitionBy("doc_id", "parent_id").orderBy("sib").rowsBetween(1, most)
        rows = rows.withColumn("following", F.collect_list("own").over(after))
    else:
        rows = rows.withColumn("following", F.array().cast(none_type))
    found = rows.filter("__is")
    options = F.lit(nopt if nopt is not None else 0)
    taken = F.aggregate("following", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x["kind"] == "option") & (a["n"] < options), 1).otherwise(0)).alias("n"), (a["on"] & (x["kind"] == "option")).alias("on")))["n"]
    args = F.when(F.col("bare"), F.array().cast(none_type)).otherwise(F.coalesce("known", F.slice("following", F.lit(1), taken + (nargs if nargs is not None else 1))))
    each = found.select("doc_id", F.col("own.node_id").alias("node_id"), "name", F.posexplode(F.concat(F.array("own"), args)).alias("nth", "a")).filter("a IS NOT NULL")
    return each.select("doc_id", "node_id", "name", "nth", F.col("a.node_id").alias("arg_id"), F.col("a.kind").alias("arg_kind"), *(F.col(f"a.{c}").alias(c) for c in shown[2:]))


def inner_text(text: str, n: Column) -> Column:
    """The source within a group, or of a node without an inside."""
    begin = F.coalesce(n["inner_start"], n["start"])
    return F.substr(F.col(text), begin + 1, F.coalesce(n["inner_stop"], n["stop"]) - begin)


def sections(parsed: DataFrame, *, names: tuple[str, ...] = ("section",), starred: bool = True) -> DataFrame:
    """(doc_id, node_id, name, title, short, line, col): every heading with its title and its short title, as written; short is null where there is none."""
    wanted = list(names) + ([f"{n}*" for n in names] if starred else [])
    # The arguments are in the same row's array; what is told of a heading is made there, so that no row carries its document.
    at = lambda a: F.try_element_at("nodes", a + 1)
    given = lambda n: F.filter(F.coalesce(n["args"], F.array().cast("array<int>")), lambda a: a.isNotNull())
    heads = F.filter("nodes", lambda n: (n["kind"] == "command") & n["name"].isin(wanted) & ~n["bare"] & (F.size(given(n)) > 0))
    short = lambda n: F.get(F.filter(given(n), lambda a: at(a)["kind"] == "option"), 0)
    told = F.transform(heads, lambda n: F.struct(n["node_id"].alias("node_id"), n["name"].alias("name"), inner_text("text", at(F.element_at(given(n), -1))).alias("title"), F.when(short(n).isNotNull(), inner_text("text", at(short(n)))).alias("short"), n["line"].alias("line"), n["col"].alias("col")))
    return parsed.select("doc_id", F.inline(told))


def graphics(parsed: DataFrame) -> DataFrame:
    return commands_arguments(parsed, list(GRAPHICS), nargs=1, nopt=1, starred=False)


def envs(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(is_env(name))


def document_bounds(nodes: DataFrame) -> DataFrame:
    """(doc_id, document, sib, last): the document environment at the top, if any."""
    return nodes.filter(is_env("document") & (F.col("parent_id") == 0)).groupBy("doc_id").agg(F.min_by(F.struct("node_id", "sib", "last"), "sib").alias("d")).select("doc_id", F.col("d.node_id").alias("document"), F.col("d.sib").alias("document_sib"), F.col("d.last").alias("document_last"))


def preamble(nodes: DataFrame) -> DataFrame:
    """The top nodes before the document environment; none where there is none."""
    return nodes.filter("parent_id = 0").join(sorted_side(document_bounds(nodes)), "doc_id").filter("sib < document_sib")


def inputs(nodes: DataFrame, document: bool | None = None) -> DataFrame:
    """`input` and `include`: in the document environment if any; True: only there; False: everywhere."""
    found = nodes.filter(is_command("input", "include"))
    if document is False:
        return found
    joined = found.join(sorted_side(document_bounds(nodes)), "doc_id", "left")
    within = (F.col("node_id") > F.col("document")) & (F.col("node_id") <= F.col("document_last"))
    return joined.filter(within if document else (F.col("document").isNull() | within))


def commands_to_next(nodes: DataFrame, name: str, *, close_at_same_level: bool = True, remove_comments: bool = True, starred: bool = True) -> DataFrame:
    """(doc_id, head, nth, node_id, kind, name, start, stop): each occurrence and its siblings up to the next one.

    Without close_at_same_level, a segment goes to the end of its group, so that segments overlap: one ordered pass over a group's siblings keeps the
    heads so far, and each sibling is told of each of them. Nothing is joined, and only the siblings themselves are sorted.
    """
    wanted = [name, f"{name}*"] if starred else [name]
    is_it = is_command(*wanted) & ~F.col("bare")
    shown = ("node_id", "kind", "name", "start", "stop", "sib")
    rows = nodes.select("doc_id", "parent_id", *shown, is_it.alias("__is"))
    upto = siblings().rowsBetween(Window.unboundedPreceding, 0)
    if not close_at_same_level:
        # How many of the group's siblings count so far; a sibling's number in a segment is what was added since its head.
        counted = rows.withColumn("__so_far", F.count_if((F.col("kind") != "comment") | F.lit(not remove_comments)).over(upto))
        met = counted.withColumn("__heads", F.collect_list(F.when(F.col("__is"), F.struct(F.col("node_id").alias("head"), F.col("__so_far").alias("before")))).over(upto))
        if remove_comments:
            met = met.filter(F.col("kind") != "comment")
        return met.withColumn("__h", F.explode("__heads")).select("doc_id", F.col("__h.head").alias("head"), (F.col("__so_far") - F.col("__h.before")).cast("int").alias("nth"), "node_id", "kind", "name", "start", "stop")
    rows = rows.withColumn("head", F.last(F.when(F.col("__is"), F.col("node_id")), ignorenulls=True).over(upto)).filter("head IS NOT NULL")
    if remove_comments:
        rows = rows.filter(F.col("kind") != "comment")
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_id", "head").orderBy("sib")) - 1
    return rows.withColumn("nth", nth).select("doc_id", "head", "nth", "node_id", "kind", "name", "start", "stop")


def lines_to_next(docs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, nth, first, last, lines): line slices from each occurrence to the next; the last to before `\\end{document}` or the end."""
    own = lines_of(docs)
    ends = own.groupBy("doc_id").agg(F.max("line").alias("n"))
    stop = nodes.filter(is_env("document")).groupBy("doc_id").agg((F.min("end_line") - 1).alias("doc_end"))
    order = Window.partitionBy("doc_id").orderBy("node_id")
    heads = nodes.filter(is_command(name) & ~F.col("bare")).select("doc_id", "node_id", "line")
    heads = heads.join(sorted_side(ends), "doc_id").join(sorted_side(stop), "doc_id", "left").select("doc_id", F.row_number().over(order).alias("nth"), F.col("line").alias("first"), F.coalesce(F.lead("line").over(order) - 1, F.col("doc_end"), F.col("n")).alias("last"))
    met = containing(own, heads.withColumn("__stop", F.col("last") + 1), at="line", start="first", stop="__stop")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("line").alias("n"), F.concat("text", "eol").alias("t")))), lambda x: x["t"])
    got = met.groupBy("doc_id", "nth").agg(listed.alias("lines"))
    return heads.join(sorted_side(got), ["doc_id", "nth"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def flat(nodes: DataFrame) -> DataFrame:
    """(doc_id, off, rank, node_id, what): opening, leaf and closing rows in document order of the walk."""
    group = F.col("kind").isin("brace", "option", "environment", "math")
    rows = nodes.filter("node_id > 0").select("doc_id", "node_id", "last", F.explode(F.when(group, F.array(F.lit("open"), F.lit("close"))).otherwise(F.array(F.lit("leaf")))).alias("what"))
    return rows.select("doc_id", F.when(F.col("what") == "close", F.col("last") * 2 + 1).otherwise(F.col("node_id") * 2).alias("rank"), F.when(F.col("what") == "close", -F.col("node_id")).otherwise(0).alias("then"), "node_id", "what")


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): a digest of the ordered nodes, to compare two runs."""
    item = F.struct("node_id", F.concat_ws("|", F.coalesce("parent_id", F.lit(-1)), "kind", "name", "content", F.col("start"), F.col("stop")).alias("t"))
    return nodes.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "\n"), 256).alias("fingerprint"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, state): added, removed, changed or same between two runs of fingerprints()."""
    b, a = before.withColumnRenamed("fingerprint", "b"), after.withColumnRenamed("fingerprint", "a")
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return b.join(sorted_side(a), "doc_id", "full").select("doc_id", state.alias("state"))


def text_between(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, first, last, text): the source from the end of one node to the start of another; spans has doc_id, first, last, stop and start."""
    return spans.join(sorted_side(docs.select("doc_id", F.col("text").alias("__text"))), "doc_id").select("doc_id", "first", "last", raw_text("__text", "stop", "start").alias("text"))


def missing_arguments(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, nth, kind): arguments by signature that a command or an environment can't do without, and lacks."""
    kinds = F.filter(F.split(F.coalesce("spec", F.lit("")), " "), lambda k: ~k.isin("s", ""))
    each = nodes.filter(F.col("args").isNotNull() & ~F.col("bare")).select("doc_id", "node_id", "name", F.posexplode(F.arrays_zip(kinds.alias("k"), F.col("args").alias("a"))).alias("nth", "x"))
    return each.filter(F.col("x.a").isNull() & F.col("x.k").rlike("^[+]?[mr]")).select("doc_id", "node_id", "name", (F.col("nth") + 1).alias("nth"), F.col("x.k").alias("kind"))


def enclosures(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """(doc_id, node_id, outer, kind, name, level): the groups around each node of `inner`, the nearest with level 1, by intervals of node numbers."""
    groups = nodes.filter(F.col("kind").isin("brace", "option", "environment", "math")).select("doc_id", F.col("node_id").alias("outer"), "kind", "name", "depth", (F.col("node_id") + 1).alias("__first"), (F.col("last") + 1).alias("__stop"))
    met = containing(inner.select("doc_id", "node_id"), groups, at="node_id", start="__first", stop="__stop")
    level = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy(F.col("depth").desc()))
    return met.withColumn("level", level).select("doc_id", "node_id", "outer", "kind", "name", "level")


def in_order(nodes: DataFrame) -> DataFrame:
    """Nodes with `place`, their rank in the order of spans: by start, what encloses first."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", F.col("stop").desc(), "node_id")))


def same_content(parsed: DataFrame) -> DataFrame:
    """(doc_id, node_id, content_hash): equal hashes are equal trees, whatever their places; compare nodes by it."""
    return content_hashes(parsed)


#: What closes each delimiter of formulas.
CLOSING = {"$": "$", "$$": "$$", "\\[": "\\]", "\\(": "\\)"}


def _delimiters(n: Column) -> tuple[Column, Column]:
    """What opens and what closes a group."""
    closing = F.create_map(*(F.lit(x) for pair in CLOSING.items() for x in pair))
    begin = lambda word: F.concat(F.lit(f"\\{word}{{"), n["name"], F.lit("}"))
    kind = n["kind"]
    return F.when(kind == "math", n["delimiter"]).when(kind == "environment", begin("begin")).when(kind == "option", "[").otherwise("{"), F.when(kind == "math", F.try_element_at(closing, n["delimiter"])).when(kind == "environment", begin("end")).when(kind == "option", "]").otherwise("}")


def _carets(content: Column) -> Column:
    """Control characters as TeX prints them."""
    odd = [k for k in (*range(32), 127) if chr(k) not in "\t\n\r"]
    written = content
    for k in odd:
        written = F.replace(written, F.lit(chr(k)), F.lit("^^" + chr(k ^ 64)))
    return F.when(content.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), written).otherwise(content)


def rewritten(parsed: DataFrame) -> DataFrame:
    """(doc_id, rewritten): the text that a document's nodes write; it reads as the same nodes.

    Nodes write themselves, groups their delimiters. Between two neighbours stands what their places say: nothing where they touch, a line end where they
    are on different lines or the first is a comment, else a blank. Documents are taken as they are read, not expanded.
    """
    source = lambda n: F.replace(F.substr("text", n["start"] + 1, n["stop"] - n["start"]), F.lit("\r\n"), F.lit("\n"))
    leaf = lambda n: F.when(n["kind"] == "command", F.concat(F.lit("\\"), _carets(n["name"]))).when(n["kind"] == "comment", F.concat(F.lit("%"), n["content"])).when(n["kind"] == "verbatim", source(n)).otherwise(_carets(n["content"]))
    token = lambda rank, then, begin, end, said, comment: F.struct(rank.cast("long").alias("rank"), then.cast("long").alias("then"), begin.alias("begin"), end.alias("end"), said.alias("said"), comment.alias("comment"))
    no = F.lit(False)

    def tokens(n: Column) -> Column:
        opening, closing = _delimiters(n)
        one = token(n["node_id"] * 2, F.lit(0), n["start"], n["stop"], leaf(n), n["kind"] == "comment")
        first = token(n["node_id"] * 2, F.lit(0), n["start"], n["inner_start"], opening, no)
        last = token(n["last"] * 2 + 1, -n["node_id"], n["inner_stop"], n["stop"], closing, no)
        return F.when(n["kind"].isin("brace", "option", "environment", "math"), F.array(first, last)).otherwise(F.array(one))

    walk = F.array_sort(F.flatten(F.transform(F.filter("nodes", lambda n: n["node_id"] > 0), tokens)))
    between = lambda a, b: F.substr("text", a["end"] + 1, b["begin"] - a["end"])
    gap = lambda a, b: F.when(a["comment"], "\n").when(b["begin"] <= a["end"], "").when(between(a, b).rlike("[\r\n]"), "\n").otherwise(" ")
    rows = parsed.select("doc_id", "text", walk.alias("w"), F.get(F.filter("nodes", lambda n: n["parent_id"] == 0), F.size(F.filter("nodes", lambda n: n["parent_id"] == 0)) - 1).alias("top"))
    rest = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(gap(a, b), b["said"]))
    # A paragraph is the blank line that follows it, so one at the end is given.
    end = F.when(F.coalesce((F.col("top.kind") == "text") & (F.col("top.content") == ""), no), "\n").otherwise("")
    return rows.select("doc_id", F.concat(F.coalesce(F.get("w", F.lit(0))["said"], F.lit("")), F.array_join(rest, ""), end).alias("rewritten"))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """(doc_id, hierarchy): one line a node, indented by depth: its kind, and name or content."""
    said = F.when(F.col("kind") == "text", F.when(F.col("content") == "", "PAR").otherwise(F.concat(F.lit("'"), "content", F.lit("'")))).when(F.col("kind") == "command", F.concat(F.lit("\\"), "name")).when(F.col("kind") == "comment", F.concat(F.lit("%"), "content")).when(F.col("kind") == "math", F.col("delimiter")).otherwise(F.concat("kind", F.lit(" "), "name"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), said)
    return nodes.filter("node_id > 0").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("hierarchy"))
