"""Diagnostics: structure events and rules of meaning over the arrays of the parsed table, their union, and renderings.

A document's nodes are one row, and what a rule asks of a node's neighbours is in the node's own context and place, so all rules are evaluated in
one pass without an exchange; only what they say is exploded. Null context means "not known", and a rule speaks only where its condition is true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.signatures import ALIGNMENTS, DISPLAY, FLOATS, LISTS, MATRICES, TABLES, builtin
from scriptorium.operators.intervals import last_before
from scriptorium.operators.related import PLACE, asked, asked_marks, lines_of_related, with_related
from scriptorium.sources.documents import lines as lines_of
from scriptorium.tables import sorted_side, written

COLUMNS = ("doc_id", "code", "severity", "message", "start", "stop", "line", "col")
RANK = {"error": 0, "warning": 1, "info": 2}
PREAMBLE_ONLY = ("usepackage", "documentclass", "RequirePackage", "includeonly", "makeindex", "PassOptionsToPackage", "PassOptionsToClass", "LoadClass", "nofiles")
#: Packages of which it is known that they define no column letters.
PLAIN = ("amsmath", "amssymb", "amsthm", "graphicx", "xcolor", "hyperref", "inputenc", "fontenc", "babel", "geometry", "booktabs")
SHORT_ARGUMENTS = ("section", "subsection", "chapter", "emph", "textbf", "textit", "caption", "title", "textrm", "texttt", "textsf", "textsc", "textsl", "underline", "label", "ref", "part", "chapter", "subsubsection", "paragraph", "subparagraph", "mbox", "makebox", "framebox")
#: How deep itemize, enumerate and all lists nest.
DEEPEST = (4, 4, 6)
#: Units of TeX lengths, and the starts of expressions that can't be decided.
LENGTH = r"^\s*[-+]?\s*(\d+\.?\d*|\.\d+|\d*,\d+)?\s*(\\[A-Za-z@]+|true)?\s*(pt|pc|in|bp|cm|mm|dd|cc|sp|ex|em|mu|nd|nc|px)?\s*((plus|minus)\s.*)?$"


def structure(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("events")).select(*COLUMNS, "fix_at", "fix")


#: Which arguments are lengths (places among a command's arguments).
LENGTHS = {"hspace": (0,), "vspace": (0,), "rule": (0, 1, 2), "\\": (0,), "setlength": (1,), "addtolength": (1,), "parbox": (3,), "raisebox": (0,), "minipage": (3,), "tabular*": (0,), "tabularx": (0,)}
#: Columns that environments have without saying so, and of a matrix.
COLUMNS_OF = {"cases": 2, "split": 2, "eqnarray": 3, "eqnarray*": 3} | dict.fromkeys(MATRICES, 10)
#: Rules that must begin a row.
RULES = ("hline", "cline", "noalign", "toprule", "midrule", "bottomrule", "cmidrule")
_SAID = "array<struct<code:string,severity:string,message:string,start:int,stop:int,line:int,col:int,fix_at:int,fix:string,by:string>>"


def _report(x, when: Column, code: str, message: Column | str, severity: Column | str = "error") -> Column:
    """A report at x where `when` is true, else null; x gives the columns of what is reported."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    none = F.lit(None)
    return F.when(when, F.struct(F.lit(code).alias("code"), as_column(severity).alias("severity"), as_column(message).alias("message"), x("start").alias("start"), x("stop").alias("stop"), x("line").alias("line"), x("col").alias("col"), none.cast("int").alias("fix_at"), none.cast("string").alias("fix"), x("by").alias("by")))


def _of(struct: Column):
    return lambda name: struct[name]


def node_rules(n, others: Column, matrices: Column) -> list[Column]:
    """The rules that a node and where it stands decide, as reports or nulls; a node may break several.

    n gives a node's columns; others: whether the document loads packages that may define columns; matrices: whether it sets the columns
    of a matrix. A null context means "not known", and no rule speaks then.
    """
    ctx, place = n("ctx"), n("place")
    kind, name, base, content, given, mode = n("kind"), n("name"), n("base_name"), n("content"), n("given"), ctx["mode"]
    live = F.coalesce(~ctx["defining"], F.lit(True)) & ~n("bare")
    command, environment = (kind == "command") & live, (kind == "environment") & live
    text, par = (kind == "text") & (content != "") & live, (kind == "text") & (content == "") & live
    no = lambda c: c == F.lit(False)
    kinds = F.filter(F.split(F.coalesce(n("spec"), F.lit("")), " "), lambda k: ~k.isin("s", ""))
    lacking = F.exists(F.zip_with(kinds, n("args"), lambda k, a: a.isNull() & k.rlike("^[+]?[mr]")), lambda x: F.coalesce(x, F.lit(False)))
    said = lambda when, code, message, severity="error": _report(n, when, code, message, severity)
    table = ctx["env"]
    formula = (mode == "math") & ~n("macro")
    columns = F.lit(None).cast("int")
    for env, count in COLUMNS_OF.items():
        columns = F.when(table == env, F.when(~matrices | (count != 10), F.lit(count))).otherwise(columns)
    columns = F.when(table.isin("alignat", "alignat*", "xalignat", "xalignat*"), 2 * F.trim(place["spec"]).try_cast("int")).when(table.isin(*sorted(TABLES)), column_count(place["spec"])).otherwise(columns)
    own_spec = F.try_element_at(given, F.lit(-1))
    length = F.lit(None).cast("array<string>")
    for owner, at in LENGTHS.items():
        length = F.when(F.coalesce(base, name) == owner, F.array(*(F.get(given, F.lit(k)) for k in at))).otherwise(length)
    not_length = lambda v: v.isNotNull() & ~F.contains(v, F.lit("#")) & ~v.rlike(r"\\[A-Za-z@]+\s*\{|\\(dim|glue|mu|num)expr") & (~v.rlike(LENGTH) | (F.trim(v) == "") | v.rlike(r"^\s*[-+]?\s*[\d.,]+\s*$"))
    defined = F.get(given, F.lit(0))
    return [
        said(command & (base == "item") & (mode == "text") & no(ctx["lists"]), "item-outside-list", "an item outside a list"),
        said(text & F.contains(content, F.lit("&")) & no(ctx["alignment"]), "ampersand-outside-alignment", "an alignment mark outside an alignment"),
        said(text & content.rlike("[_^]") & (mode == "text"), "script-outside-math", "a script outside a formula"),
        said(command & n("args").isNotNull() & lacking, "missing-argument", "an argument is missing"),
        said(((command & (n("mode") == "math")) | (environment & (n("mode") == "math"))) & ~n("macro") & (mode == "text"), "math-command-in-text", F.when(kind == "command", "a command of formulas in text").otherwise("an environment of formulas in text")),
        said(command & base.isin("part", "chapter", "section", "subsection", "subsubsection", "maketitle", "caption", "footnote", "tableofcontents", "item") & (mode == "math"), "invalid-in-math", "a command of text in a formula"),
        said(environment & name.isin(*sorted(DISPLAY)) & (mode == "math"), "display-in-math", "a display within a formula"),
        said(command & (base == "caption") & no(ctx["floating"]), "caption-outside-float", "a caption outside a float"),
        said(command & base.isin(*PREAMBLE_ONLY) & (ctx["body"] == F.lit(True)), "preamble-only", "this belongs in the preamble"),
        said(command & (base == "tag") & formula & (mode == "math") & no(ctx["tags"]), "tag-not-allowed", "a tag outside a display"),
        said(par & (mode == "math") & table.isin(*sorted(DISPLAY)), "blank-line-in-math", "an empty line in a formula"),
        said(par & ctx["arg_of"].isin(*SHORT_ARGUMENTS), "blank-line-in-argument", "an empty line in an argument that can't hold a paragraph"),
        said((kind == "verbatim") & live & (F.coalesce(ctx["arg_of"], F.lit("")) != "") & base.isin("verb", "lstinline"), "verb-in-argument", "verbatim in an argument"),
        said(environment & name.isin(*sorted(FLOATS)) & (ctx["boxed"] == F.lit(True)) & ~F.coalesce(F.get(given, F.lit(0)) == "H", F.lit(False)), "float-in-box", "a float in a box"),
        said(environment & name.isin(*sorted(LISTS)) & (((name == "itemize") & (ctx["itemize"] >= DEEPEST[0])) | ((name == "enumerate") & (ctx["enumerate"] >= DEEPEST[1])) | (ctx["nested"] >= DEEPEST[2])), "too-deeply-nested", "lists are nested too deeply"),
        said(command & (name == "right") & place["pair"].isNull() & ~F.coalesce(place["across"], F.lit(False)), "right-without-left", "no left is open"),
        said(command & (name == "middle") & place["pair"].isNull(), "middle-without-left", "no left is open"),
        said(command & (name == "left") & place["pair"].isNull() & ~F.coalesce(place["across"], F.lit(False)), "left-without-right", "no right closes this"),
        said(command & (name == "left") & place["across"], "left-across-cells", "a cell ends before this is closed"),
        said(command & (base == "label") & (place["nth"] > 1), "multiple-labels", "a second label in this equation"),
        said(command & (base == "tag") & (place["nth"] > 1), "multiple-tags", "a second tag in this equation"),
        said(table.isin(*sorted(LISTS)) & place["first"] & live, "text-before-item", "text before the first item"),
        said(text & (n("parent_id") == 0) & place["first"], "text-in-preamble", "text in the preamble"),
        said(command & name.isin("\\", "\\*", "newline") & (mode == "text") & no(ctx["alignment"]) & place["after_par"], "line-break-without-line", "there is no line to break"),
        said(command & base.isin(*RULES) & table.isin(*sorted(ALIGNMENTS)) & (place["lead"] != "row"), "misplaced-rule", "a rule within a row"),
        said(command & (base == "multicolumn") & table.isin(*sorted(ALIGNMENTS)) & (place["lead"] == ""), "misplaced-multicolumn", "a span within a cell"),
        said(live & (place["cells"] > columns), "too-many-columns", F.format_string("%d cells in a row of %d columns", place["cells"], columns)),
        said(environment & name.isin(*sorted(TABLES)) & own_spec.isNotNull() & ~others & column_count(F.when(name == "tabularx", F.replace(own_spec, F.lit("X"), F.lit("l"))).otherwise(own_spec), standard=True).isNull(), "unknown-column", F.concat(F.lit("unknown column in "), own_spec)),
        said((command | environment) & F.exists(length, not_length), "invalid-length", "not a length"),
        said(command & base.isin("newcommand", "renewcommand", "providecommand", "DeclareRobustCommand") & defined.isNotNull() & ~F.contains(defined, F.lit("#")) & ~F.trim(defined).rlike(r"^\\([A-Za-z@]+|[^A-Za-z])$"), "not-a-command-name", "this is no name of a command"),
    ]


def definition_reports(d) -> list[Column]:
    """illegal-parameter and already-defined, of a definition's columns."""
    environment = F.contains(F.lower(d("how")), F.lit("environment"))
    used = F.when(d("highest") >= 10, F.lit("a parameter in what ends it")).otherwise(F.format_string("parameter %d of %d", d("highest"), d("arity")))
    return [
        _report(d, d("highest") > d("arity"), "illegal-parameter", used),
        _report(d, d("known") & d("how").isin("newcommand", "NewDocumentCommand", "newenvironment", "NewDocumentEnvironment"), "already-defined", F.concat(F.when(environment, F.lit("")).otherwise(F.lit("\\")), d("name"), F.lit(" is already defined"))),
    ]


def _doc_facts() -> tuple[Column, Column]:
    """(others, matrices): whether a document loads packages, or has a class, that may define columns; whether it says how many a matrix has."""
    others = F.exists("packages", lambda p: ~p.isin(*PLAIN)) | ~F.coalesce("class", F.lit("")).isin("", "article", "report", "book", "letter", "minimal")
    return others, F.array_contains("counters", "MaxMatrixCols")


def reports(parsed: DataFrame) -> DataFrame:
    """(doc_id, found): all reports of a document as an array, from one reading of its nodes; no row leaves its document."""
    others, matrices = _doc_facts()
    parts = [
        F.transform("events", lambda e: F.struct(*(e[c].alias(c) for c in ("code", "severity", "message", "start", "stop", "line", "col", "fix_at", "fix", "by")))),
        F.flatten(F.transform("nodes", lambda n: F.array_compact(F.array(*node_rules(_of(n), F.col("__others"), F.col("__matrices")))))),
        F.flatten(F.transform("definitions", lambda d: F.array_compact(F.array(*definition_reports(_of(d)))))),
    ]
    return parsed.withColumns({"__others": others, "__matrices": matrices}).select(*(c for c in ("doc_id", "nodes", "definitions", "inclusions", "fragment") if c in parsed.columns), F.concat(*(p.cast(_SAID) for p in parts)).alias("found"))


def column_count(spec: Column, *, standard: bool = False) -> Column:
    """The number of columns of a table's specification; null where it has letters that aren't known, or (standard) that need a package."""
    plain = F.regexp_replace(spec, r"[@!<>]\s*\{(?:[^{}]|\{[^{}]*\})*\}|[|\s]", "")
    # Repetitions are written out, a level a time; deeper ones than REPEATED are not known.
    for _ in range(REPEATED):
        plain = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(r"\*\{\d+\}\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\*\d\{[^{}]*\}|[^*]|\*"), F.lit(0)), lambda p: F.when(F.startswith(p, F.lit("*")) & (F.length(p) > 1), F.repeat(F.regexp_extract(p, r"(?s)^\*\{?\d+\}?\{(.*)\}$", 1), F.regexp_extract(p, r"^\*\{?(\d+)", 1).try_cast("int"))).otherwise(p)), "")
    letters = F.regexp_replace(plain, r"\{(?:[^{}]|\{[^{}]*\})*\}", "")
    return F.when(letters.rlike("^[lcrp]*$" if standard else "^[lcrpmbXS]*$"), F.length(letters))


REPEATED = 4


def names_met(parsed: DataFrame) -> DataFrame:
    """(doc_id, kind, base_name, start, stop, line, col, by): uses of commands and environments that nothing known defines."""
    wanted = lambda n: n["kind"].isin("command", "environment") & n["spec"].isNull() & ~n["macro"] & n["base_name"].rlike("^[A-Za-z]{3,}$") & ~F.coalesce(n["ctx"]["defining"], F.lit(False)) & ~((n["kind"] == "command") & n["base_name"].isin("begin", "end"))
    return F.transform(F.filter("nodes", wanted), lambda n: F.struct(*(n[c].alias(c) for c in ("kind", "base_name", "start", "stop", "line", "col", "by"))))


def _unknown(met: DataFrame, own: DataFrame) -> DataFrame:
    """Names met once in a document that are one substitution or one swap of neighbours from a known name of the same length: infos.

    met has (doc_id, kind, base_name, start, ...), own has (doc_id, kind, known). Variants are joined by name with one letter blanked or two
    swapped, so nothing is compared with everything. The alphabetically first candidate is named.
    """
    spark, table = met.sparkSession, builtin()
    once = met.groupBy("doc_id", "kind", "base_name").agg(F.count("*").alias("n"), F.min(F.struct("start", "stop", "line", "col", "by")).alias("at")).filter("n = 1")
    # A name that the document defines is no typo where it is defined.
    once = once.join(sorted_side(own.select("doc_id", "kind", F.col("known").alias("base_name"))), ["doc_id", "kind", "base_name"], "left_anti")
    fixed = [("command", n) for n in sorted(table.commands) if n.isalpha() and len(n) > 2] + [("environment", n) for n in sorted(table.environments) if n.isalpha() and len(n) > 2]
    known = spark.createDataFrame(fixed, "kind string, known string")  # a fixed table
    places = lambda c: F.sequence(F.lit(1), F.length(c))
    blank = lambda c: F.transform(places(c), lambda i: F.overlay(F.col(c), F.lit("?"), i))
    swaps = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.overlay(F.col(c), F.concat(F.substr(c, i + 1, F.lit(1)), F.substr(c, i, F.lit(1))), i))
    tried = once.select("doc_id", "kind", "base_name", "at", F.explode(F.concat(blank("base_name"), swaps("base_name"))).alias("key"))
    keys = lambda df, *c: df.select(*c, "kind", "known", F.explode(F.concat(blank("known"), F.array("known"))).alias("key"))
    a = tried.join(F.broadcast(keys(known)), ["kind", "key"]).select("doc_id", "kind", "base_name", "at", "known")
    b = tried.join(sorted_side(keys(own, "doc_id")), ["doc_id", "kind", "key"]).select("doc_id", "kind", "base_name", "at", "known")
    met = a.unionByName(b).filter(F.lower("base_name") != F.lower("known")).groupBy("doc_id", "kind", "base_name", "at").agg(F.min("known").alias("known"))
    mark = F.when(F.col("kind") == "command", "\\").otherwise("")
    code = F.when(F.col("kind") == "command", "unknown-command").otherwise("unknown-environment")
    return met.select("doc_id", code.alias("code"), F.lit("info").alias("severity"), F.concat(mark, "base_name", F.lit(": did you mean "), mark, "known", F.lit("?")).alias("message"), "at.start", "at.stop", "at.line", "at.col", "at.by")


def _own_names() -> Column:
    return F.transform(F.filter("definitions", lambda d: F.length(d["name"]) > 2), lambda d: F.struct(F.when(F.contains(F.lower(d["how"]), F.lit("environment")), "environment").otherwise("command").alias("kind"), d["name"].alias("known")))


def unknown_names(parsed: DataFrame) -> DataFrame:
    return _unknown(parsed.select("doc_id", F.inline(names_met(parsed))), parsed.select("doc_id", F.inline(_own_names()))).select(*COLUMNS)


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Included names (doc_id, fragment, folder, command, target, extension, start, ...) that no file of the manifest (path) fits: a semi join.

    A name is looked for once from a folder, however many documents include it there; wanted is a table, as it is read twice.
    """
    from scriptorium.sources.documents import resolved

    name = ["folder", "target", "extension"]
    lost = wanted.join(sorted_side(resolved(wanted.select(*name).distinct(), files).filter("path IS NULL").select(*name)), name, "left_semi")
    severity = F.when(F.col("fragment") | (F.col("command") == "include"), "warning").otherwise("error")
    return lost.select("doc_id", F.lit("file-not-found").alias("code"), severity.alias("severity"), F.concat("target", F.lit(" is not found")).alias("message"), "start", "stop", "line", "col", "by")


def _wanted(parsed: DataFrame, folders: DataFrame | None) -> DataFrame:
    """Inclusions to be looked for, as a table of their own: files and images. Packages and classes are not: most are of a distribution."""
    rows = parsed.select("doc_id", "fragment", F.inline("inclusions")).filter(F.col("extension").isin(".tex", "") & ~F.contains("target", F.lit("#")) & ~F.contains("target", F.lit("\\")))
    if folders is None:
        return written(rows.withColumn("folder", F.lit("")), "wanted")
    return written(rows.join(sorted_side(folders.select("doc_id", F.coalesce("folder", F.lit("")).alias("folder"))), "doc_id", "left").fillna("", "folder"), "wanted")


def files_not_found(parsed: DataFrame, files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Included files and images that no file of the manifest (path) fits, from the folders (doc_id, folder) of the documents."""
    return missing_files(_wanted(parsed, folders), files).select(*COLUMNS)


def diagnose(parsed: DataFrame, files: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Structure and meaning together: COLUMNS, fix_at, fix, by and related. Order by doc_id, start, stop, code to render.

    The parsed table is read once: what its rules say, and the few names and inclusions that are joined, go to a table of their own.
    """
    kept = written(reports(parsed).withColumn("asked", asked(F.col("found"))).select("doc_id", "fragment", "found", asked_marks("asked", SHORT_ARGUMENTS).alias("marks"), names_met(parsed).alias("met"), _own_names().alias("own"), "inclusions"), "reports")
    found = with_related(kept)
    more = _unknown(kept.select("doc_id", F.inline("met")), kept.select("doc_id", F.inline("own")))
    if files is not None:
        more = more.unionByName(missing_files(_wanted(kept, folders), files))
    none = F.lit(None)
    return found.unionByName(more.withColumns({"fix_at": none.cast("int"), "fix": none.cast("string"), "related": F.array().cast(PLACE)}))


def meaning(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All rules of meaning over a parsed table, without those of structure."""
    out = _rules(parsed, None).unionByName(unknown_names(parsed))
    return out if files is None else out.unionByName(files_not_found(parsed, files))


def _rules(parsed: DataFrame, codes: tuple[str, ...] | None) -> DataFrame:
    none = F.array().cast("array<struct<code:string,severity:string,message:string,start:int,stop:int,line:int,col:int,end_line:int,end_col:int,fix_at:int,fix:string,by:string>>")
    rows = reports(parsed.withColumn("events", none)).select("doc_id", F.inline("found")).select(*COLUMNS)
    return rows.filter(F.col("code").isin(*codes)) if codes else rows


def pair_rules(parsed: DataFrame) -> DataFrame:
    """left, middle and right, which are matched among siblings."""
    return _rules(parsed, ("right-without-left", "middle-without-left", "left-without-right", "left-across-cells"))


def order_rules(parsed: DataFrame) -> DataFrame:
    """Rules about what comes before or again: labels and tags of an equation, text before an item, breaks without a line."""
    return _rules(parsed, ("multiple-labels", "multiple-tags", "text-before-item", "text-in-preamble", "line-break-without-line"))


def too_many_columns(parsed: DataFrame) -> DataFrame:
    """Rows of tables with more cells than columns; reported at the end of the row."""
    return _rules(parsed, ("too-many-columns",))


def definition_rules(parsed: DataFrame) -> DataFrame:
    return _rules(parsed, ("illegal-parameter", "already-defined", "not-a-command-name"))


def invalid_lengths(parsed: DataFrame) -> DataFrame:
    return _rules(parsed, ("invalid-length",))


def in_source(found: DataFrame) -> DataFrame:
    """Diagnostics of views, whose places are the source's, as a reader of the source gets them.

    What a macro wrote says so; what several uses would say at one place is said once, as the first of them says it.
    """
    written_by = F.when(F.col("by").isNotNull(), F.concat("message", F.lit(" (written by \\"), "by", F.lit(")"))).otherwise(F.col("message"))
    rest = F.struct("severity", "line", "col", "fix_at", "fix", "related")
    return found.withColumn("message", written_by).groupBy("doc_id", "code", "message", "start", "stop").agg(F.min(rest).alias("r")).select("doc_id", "code", "r.severity", "message", "start", "stop", "r.line", "r.col", "r.fix_at", "r.fix", "r.related")


def check(docs: DataFrame, files: DataFrame | None = None, *, expanded: bool = True, follow_inputs: bool = True, store: str | None = None) -> DataFrame:
    """Diagnostics (COLUMNS, fix_at, fix and related) of documents, by default of their expanded views, at source places.

    Where docs has a column `path`, documents know what the files of docs that they include define, unless follow_inputs is false, and names
    are looked for from their own folder. store: a folder that keeps what files define from run to run.
    """
    from scriptorium.operators.includes import parse_together
    from scriptorium.operators.nodes import parse

    paths = "path" in docs.columns
    parsed = parse_together(docs, expanded=expanded, store=store) if paths and follow_inputs else parse(docs, expanded=expanded)
    folders = docs.select("doc_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")) if paths else None
    found = diagnose(parsed, files, folders)
    return in_source(found) if expanded else found.drop("by")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def tallies(found: DataFrame, examples: int = 5) -> DataFrame:
    """(severity, code, n, examples): counts, and at most so many places each."""
    nth = F.row_number().over(Window.partitionBy("severity", "code").orderBy("doc_id", "start"))
    counted = found.groupBy("severity", "code").agg(F.count("*").alias("n"))
    few = found.withColumn("nth", nth).filter(F.col("nth") <= examples).groupBy("severity", "code").agg(F.sort_array(F.collect_list(F.struct("doc_id", "line", "col"))).alias("examples"))
    return counted.join(few, ["severity", "code"])


def line_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, line, first): where each line of a document begins."""
    size = F.length("text") + F.length("eol")
    return lines_of(docs).select("doc_id", "line", (F.sum(size).over(Window.partitionBy("doc_id").orderBy("line")) - size).alias("first"))


def with_ends(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Diagnostics with end_line and end_col: the last line that begins at or before their end, in one pass over both."""
    ends = last_before(found, line_starts(docs), at="stop", marked="first", mark="__line")
    mark = lambda c, other: F.coalesce(F.col(f"__line.{c}"), F.lit(other))
    return ends.withColumns({"end_line": mark("line", 1).cast("int"), "end_col": (F.col("stop") - mark("first", 0)).cast("int")}).drop("__line")


def suggestion(found: DataFrame) -> Column:
    """What a fix proposes, in words; null where nothing is proposed."""
    if "fix" not in found.columns:
        return F.lit(None).cast("string")
    return F.when(F.col("fix").isNotNull(), F.concat(F.lit("put in "), "fix"))


def to_json(found: DataFrame, docs: DataFrame | None = None, *, keep: tuple[str, ...] = (), nulls: bool = False) -> DataFrame:
    """(doc_id, json): one object a diagnostic, columns from 1; with docs (doc_id, text, path) also the file, the end, related places and what is suggested.

    keep: columns of found to stand beside, as for an order; nulls: fields without a value are written as null.
    """
    fields = [F.col("line"), (F.col("col") + 1).alias("column"), "severity", "code", "message"]
    if docs is not None:
        if "fix" in found.columns:
            fields.append(suggestion(found).alias("suggestion"))
        if "related" in found.columns:
            fields.append(F.transform("related", lambda r: F.struct(r["line"].alias("line"), (r["col"] + 1).alias("column"), r["end_line"].alias("end_line"), (r["end_col"] + 1).alias("end_column"), r["message"].alias("message"))).alias("related"))
        found = with_ends(found, docs)
        if "path" in docs.columns:
            found = found.join(sorted_side(docs.select("doc_id", F.col("path").alias("__path"))), "doc_id")
            fields = [F.col("__path").alias("file"), *fields]
        fields = [*fields, F.col("end_line"), (F.col("end_col") + 1).alias("end_column")]
    return found.select("doc_id", *keep, F.to_json(F.struct(*fields), {"ignoreNullFields": str(not nulls).lower()}).alias("json"))


def _excerpt(source: Column, col: Column, size: Column, width: int) -> Column:
    """A window of a line around a place, and a mark under it. A longer line is shown from a quarter of the window before, and so that the window is full."""
    begin = F.when(F.length(source) <= width, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(col - width // 4, F.length(source) - width)))
    wide = F.greatest(F.lit(0), F.least(size, F.length(source) - col, F.lit(width) - (col - begin)) - 1)
    return F.concat(F.substr(source, begin + 1, F.lit(width)), F.lit("\n"), F.repeat(F.lit(" "), col - begin), F.lit("^"), F.repeat(F.lit("~"), wide))


def render_text(found: DataFrame, docs: DataFrame, width: int = 100, *, color: bool = False, fixes: bool = False) -> DataFrame:
    """(doc_id, line, col, rendered): header, a window of the line around the place, a mark under it, the same of related places, and (fixes) what is suggested."""
    lines = lines_of(docs)
    joined = found.join(sorted_side(lines.select("doc_id", "line", F.col("text").alias("source"))), ["doc_id", "line"], "left").withColumn("source", F.coalesce("source", F.lit("")))
    related = F.lit("")
    if "related" in found.columns:
        joined = joined.join(sorted_side(lines_of_related(found, lines)), "doc_id", "left")
        one = lambda r: F.concat(F.lit("\n"), _excerpt(F.coalesce(F.try_element_at("__lines", r["line"]), F.lit("")), r["col"], r["stop"] - r["start"], width), F.lit(" "), r["message"])
        related = F.array_join(F.transform("related", one), "")
    fix = F.when(suggestion(found).isNotNull(), F.concat(F.lit("\n= "), suggestion(found))).otherwise("") if fixes and "fix" in found.columns else F.lit("")
    tone = F.when(F.col("severity") == "error", "\x1b[31m").when(F.col("severity") == "warning", "\x1b[33m").otherwise("\x1b[36m")
    severity = F.concat(tone, "severity", F.lit("\x1b[0m")) if color else F.col("severity")
    return joined.select("doc_id", "line", "col", F.concat(F.format_string("%d:%d: %s [%s] %s\n", "line", F.col("col") + 1, severity, "code", "message"), _excerpt(F.col("source"), F.col("col"), F.col("stop") - F.col("start"), width), related, fix).alias("rendered"))


def code_counts(found: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, infos): the counts of each document."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    return found.groupBy("doc_id").agg(count("error"), count("warning"), count("info"))
