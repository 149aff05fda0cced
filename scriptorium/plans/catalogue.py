"""Registered queries over LaTeX corpora, and the SQL that states their answers straight from the tables.

The tables hold no LaTeX, so documents are made of their columns (PART documents hold 50 consecutive parts each) and the operators
recover from them what SQL says of the columns. Numbers are cast to BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import messages, signatures
from scriptorium.operators import diagnostics, edits, nodes, outline, tree
from scriptorium.plans import changes, rules, structure, views
from scriptorium.plans.documents import PART, _big, _say, _t, order_documents, part_documents
from scriptorium.sources import documents
from scriptorium.streaming import buffers
from scriptorium.tables import sorted_side, written

def tex_sections(spark, sf_dir):
    """Every section title of every document, with its position."""
    docs = part_documents(spark, sf_dir, _say("\\section{@} of @ % @", "p_name", "p_brand", "p_type"))
    return tree.sections(nodes.parse(docs)).select(_big("doc_id"), "title", _big("line"), _big("col"))


def tex_arguments(spark, sf_dir):
    docs = part_documents(spark, sf_dir, _say("\\includegraphics[width=@]{p/@}", "p_size", "p_partkey"))
    p = nodes.parse(docs)
    found = tree.graphics(p).filter("nth > 0").join(sorted_side(docs), "doc_id")
    return found.select(_big("doc_id"), _big("nth"), "arg_kind", F.substr("text", F.col("inner_start") + 1, F.col("inner_stop") - F.col("inner_start")).alias("argument"))


def tex_bound_arguments(spark, sf_dir):
    """By signature: a character each where braces lack."""
    docs = part_documents(spark, sf_dir, F.concat(F.lit("$\\frac"), F.lpad((F.col("p_size") % 90 + 10).cast("string"), 2, "0"), F.lit("$")))
    got = tree.commands_arguments(nodes.parse(docs), ["frac"]).filter("nth > 0")
    return got.select(_big("doc_id"), _big("nth"), (F.col("stop") - F.col("start")).cast("long").alias("size"), _big("line"))


def tex_environments(spark, sf_dir):
    docs = order_documents(spark, sf_dir, _say("\\item @ of @", "l_quantity", "l_partkey"), "\\begin{itemize}\n", "\n\\end{itemize}\n")
    # The items are counted in the document's own row, so it is read once and nothing is joined.
    items = F.size(F.filter("nodes", lambda n: (n["kind"] == "command") & (n["name"] == "item") & (n["env"] == "itemize")))
    p = nodes.plain(docs, "kind", "name", "end_line", "env").select("doc_id", "nodes", items.alias("items")).filter("items > 0")
    rows = p.select("doc_id", "items", F.inline(F.filter("nodes", lambda n: n["kind"].isin("environment", "verbatim"))))
    return rows.filter(tree.is_env("itemize")).select(_big("doc_id", "l_orderkey"), _big("end_line", "last_line"), _big("items"))


def tex_to_next(spark, sf_dir):
    docs = part_documents(spark, sf_dir, F.concat(_say("\\chapter{@}", "p_partkey"), F.repeat(F.lit("\\emph{x}"), (F.col("p_size") % 4).cast("int"))))
    got = tree.commands_to_next(nodes.nodes(nodes.parse(docs)), "chapter")
    return got.groupBy("doc_id", "head").agg(F.count("*").alias("n"), F.max("nth").cast("long").alias("last")).select(_big("doc_id"), "n", "last")


def tex_lines_to_next(spark, sf_dir):
    docs = part_documents(spark, sf_dir, F.concat(_say("\\section{@}", "p_name"), F.repeat(F.lit("\nmore"), (F.col("p_size") % 3).cast("int"))))
    got = tree.lines_to_next(docs, nodes.nodes(nodes.parse_once(docs)), "section")
    return got.select(_big("doc_id"), _big("nth"), (F.size("lines")).cast("long").alias("n_lines"), F.regexp_extract(F.col("lines")[0], r"\{(.*)\}", 1).alias("title"))


def tex_preamble(spark, sf_dir):
    head = "\\documentclass{article}\n\\usepackage{a}\n\\begin{document}\n"
    docs = part_documents(spark, sf_dir, _say("\\input{p/@}", "p_partkey"), head).withColumn("text", F.concat("text", F.lit("\n\\end{document}\n\\input{after}")))
    n = nodes.nodes(nodes.parse_once(docs))
    before = tree.preamble(n).groupBy("doc_id").agg(F.count_if(F.col("kind") == "command").alias("commands"))
    within = tree.inputs(n, True).groupBy("doc_id").agg(F.count("*").alias("inputs"))
    return before.join(sorted_side(within), "doc_id").select(_big("doc_id"), _big("commands"), _big("inputs"))


def tex_expansion(spark, sf_dir):
    docs = part_documents(spark, sf_dir, _say("\\size{@}{@}", "p_size", "p_name"), "\\newcommand{\\size}[2]{#2 in \\unit{#1}}\\newcommand{\\unit}[1]{#1 cm}%\n")
    v = nodes.views(docs).select("doc_id", F.posexplode(F.split("view", "\n")).alias("n", "line")).filter("n > 0")
    return v.select(_big("doc_id"), _big("n"), "line")


def tex_provenance(spark, sf_dir):
    """The expansions of each line and their places in the source."""
    docs = part_documents(spark, sf_dir, _say("\\name{@}", "p_partkey"), "\\newcommand{\\name}[1]{part #1}%\n")
    v = nodes.views(docs).select("doc_id", "text", F.inline("expansions"))
    return v.select(_big("doc_id"), F.substr("text", F.col("source") + 1, F.col("source_stop") - F.col("source")).alias("used"), _big("depth"))


def tex_unclosed(spark, sf_dir):
    """Braces left open in one line of seven, told once each, at their places."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\emph{"), F.col("p_name"), F.when(F.col("p_size") % 7 == 0, "").otherwise("}")).alias("text"))
    return diagnostics.structure(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "code", _big("line"), _big("col"), _big("fix_at"), "fix")


def tex_meaning(spark, sf_dir):
    """Rules of meaning on documents that break one of them each."""
    body = (
        F.when(F.col("p_size") % 6 == 0, "\\item x").when(F.col("p_size") % 6 == 1, "a & b").when(F.col("p_size") % 6 == 2, "a^2").when(F.col("p_size") % 6 == 3, "\\caption{c}").when(F.col("p_size") % 6 == 4, "\\usepackage{d}").otherwise("fine")
    )
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\documentclass{article}\n\\begin{document}\n"), body, F.lit("\n\\end{document}\n")).alias("text"))
    return diagnostics.diagnose(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "code", "severity", _big("line"), _big("col"))


def tex_summary(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("$x"), F.when(F.col("p_size") % 3 == 0, "").otherwise("$"), F.when(F.col("p_size") % 5 == 0, "}").otherwise("")).alias("text"))
    return diagnostics.tallies(diagnostics.structure(nodes.parse(docs)).select(*diagnostics.COLUMNS)).select("severity", "code", _big("n"))


def tex_too_many_columns(spark, sf_dir):
    row = F.concat(F.array_join(F.array_repeat(F.lit("x"), F.col("p_size") % 5 + 1), " & "), F.lit(" \\\\"))
    docs = part_documents(spark, sf_dir, row, "\\begin{tabular}{l|c*{1}{r}}\n").withColumn("text", F.concat("text", F.lit("\n\\end{tabular}")))
    return diagnostics.too_many_columns(nodes.parse(docs)).select(_big("doc_id"), _big("line"), "message")


def tex_delimiters(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("$"), F.when(F.col("p_size") % 4 == 0, "").otherwise("\\left( "), F.lit("x"), F.when(F.col("p_size") % 4 == 1, "").otherwise(" \\right)"), F.lit("$")).alias("text"))
    return diagnostics.pair_rules(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "code", _big("col"))


def tex_equation_labels(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\begin{equation}\n"), F.repeat(F.lit("\\label{l}\n"), (F.col("p_size") % 4).cast("int")), F.lit("x\n\\end{equation}")).alias("text"))
    return diagnostics.order_rules(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "code", _big("line"))


def tex_definitions(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\newcommand{\\mine}["), (F.col("p_size") % 4).cast("string"), F.lit("]{a #2}")).alias("text"))
    return diagnostics.definition_rules(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "code", "message")


def tex_lengths(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("cm", "", "pt", "kg", "em"))), (F.col("p_size") % 5 + 1).cast("int"))
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\hspace{"), F.col("p_size").cast("string"), unit, F.lit("}")).alias("text"))
    return diagnostics.invalid_lengths(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "code")


def tex_missing_files(spark, sf_dir):
    """Includes that no file of a manifest fits."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\input{./p/@}", "p_partkey").alias("text"))
    files = _t(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 1, ".tex").otherwise("")).alias("path"))
    return diagnostics.files_not_found(nodes.parse(docs), files).select(_big("doc_id", "p_partkey"), "severity", "message")


def tex_typos(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 3 == 0, "\\secton{x} \\hline").when(F.col("p_size") % 3 == 1, "\\setcion{x}").otherwise("\\sectiom{x} \\zzzzzzz").alias("text"))
    return diagnostics.unknown_names(nodes.parse_once(docs)).select(_big("doc_id", "p_partkey"), "message", _big("col"))


def tex_check_expanded(spark, sf_dir):
    """Mistakes that a macro writes, at the places of its uses."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\documentclass{a}\\newcommand{\\bad}{\\item}\n\\begin{document}\n"), F.when(F.col("p_size") % 2 == 0, "\\bad").otherwise("good"), F.lit("\n\\end{document}")).alias("text"))
    return diagnostics.check(docs).select(_big("doc_id", "p_partkey"), "code", "message", _big("line"), _big("col"))


def tex_edits(spark, sf_dir):
    docs = part_documents(spark, sf_dir, _say("\\section{@} @", "p_name", "p_brand"))
    found = nodes.nodes(nodes.parse(docs)).filter(tree.is_command("section"))
    new = edits.rewrite(docs, edits.corrected(found, F.lit("\\subsection")))
    return new.select(_big("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", _big("n"), "line")


def tex_quick_fixes(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\emph{"), F.col("p_name"), F.when(F.col("p_size") % 7 == 0, "").otherwise("}")).alias("text"))
    return edits.rewrite(docs, edits.quick_fixes(diagnostics.structure(nodes.parse(docs)))).select(_big("doc_id", "p_partkey"), "text")


def tex_prose(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\section{@}\n\\emph{@}~@ % note\nand \\textbf{more}\\label{x}", "p_name", "p_brand", "p_size").alias("text"))
    return nodes.prose(docs).select(_big("doc_id", "p_partkey"), "prose")


def tex_search(spark, sf_dir):
    """Matches in prose, with their places in the source."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\textbf{size} @ \\emph{of size} @", "p_size", "p_partkey").alias("text"))
    return nodes.search(nodes.prose(docs), "size").select(_big("doc_id", "p_partkey"), _big("nth"), "hit", _big("at"), _big("source"))


def tex_outline(spark, sf_dir):
    """Words of each section with those below it."""
    docs = part_documents(spark, sf_dir, F.concat(F.when(F.col("p_partkey") % 5 == 0, "\\section{s} ").otherwise("\\subsection{t} "), F.repeat(F.lit("word "), (F.col("p_size") % 4 + 1).cast("int"))))
    p = nodes.parse_once(docs)
    blocks = outline.section_blocks(p)
    got = outline.rolled_up(blocks, outline.block_stats(p)).filter("key = 'words'").join(sorted_side(blocks.select("doc_id", "block_id", "label", "line")), ["doc_id", "block_id"])
    return got.select(_big("doc_id"), "label", _big("line"), _big("n", "words"))


def tex_catcodes(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, "\\makeatletter\\a@b\\makeatother").otherwise("{\\makeatletter}\\a@b").alias("text"))
    n = nodes.nodes(nodes.parse(docs)).filter((F.col("kind") == "command") & F.startswith("name", F.lit("a")))
    return n.select(_big("doc_id", "p_partkey"), "name", _big("col"))


def tex_verbatim(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\verb|@{| \\begin{verbatim}\n%$@\n\\end{verbatim}", "p_name", "p_size").alias("text"))
    n = nodes.nodes(nodes.parse(docs)).filter("kind = 'verbatim'")
    return n.select(_big("doc_id", "p_partkey"), "name", "content")


def tex_lines(spark, sf_dir):
    """Lines of the documents table."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.lines(docs).select(_big("doc_id"), _big("line"), F.length("text").cast("long").alias("size"))


def tex_comments(spark, sf_dir):
    """Comments of the documents table, in which no backslash occurs."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text").filter("instr(text, '%') > 0")
    return nodes.nodes(nodes.parse(docs)).filter("kind = 'comment'").select(_big("doc_id"), _big("line"), _big("col"), "content")


def tex_environment_tally(spark, sf_dir):
    docs = order_documents(spark, sf_dir, _say("\\begin{quote}@\\end{quote}", "l_partkey"), "\\begin{center}\n", "\n\\end{center}")
    return outline.environments_counted(nodes.nodes(nodes.plain(docs, "kind", "name"))).select("name", _big("n"))


def tex_fingerprints(spark, sf_dir):
    """Digests of two runs over documents of which some differ."""
    part = _t(spark, sf_dir, "part")
    before = part.filter("p_size % 4 <> 0").select(F.col("p_partkey").alias("doc_id"), _say("\\emph{@}", "p_name").alias("text"))
    after = part.filter("p_size % 4 <> 1").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\emph{"), F.col("p_name"), F.when(F.col("p_size") % 4 == 2, "!").otherwise(""), F.lit("}")).alias("text"))
    fp = lambda d: tree.fingerprints(nodes.nodes(nodes.parse(d)))
    return tree.compared(fp(before), fp(after)).select(_big("doc_id", "p_partkey"), "state")


def tex_walk(spark, sf_dir):
    """The flat walk: an opening and a closing row for each group, a row for each leaf."""
    docs = order_documents(spark, sf_dir, _say("{@}", "l_partkey"), "", "")
    return tree.flat(nodes.nodes(nodes.plain(docs, "node_id", "kind", "last"))).groupBy("doc_id", "what").agg(F.count("*").alias("n")).select(_big("doc_id", "l_orderkey"), "what", _big("n"))


def tex_conditionals(spark, sf_dir):
    """Branches and whether they are taken."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\newif\\ifodd\\ifnum @<25 small\\else large\\fi \\iffalse never\\fi \\ifodd x\\fi", "p_size").alias("text"))
    got = nodes.branches(nodes.parse(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("taken").alias("taken"), F.min(F.when(F.col("taken"), F.col("second"))).alias("second"))
    return got.select(_big("doc_id", "p_partkey"), _big("n"), _big("taken"), "second")


def tex_expansion_environments(spark, sf_dir):
    """What begins and ends an environment, with its arguments, star and defaults."""
    head = "\\newenvironment{boxed}[2][d]{<#1:#2|}{|>}\\NewDocumentCommand\\pick{s O{def} m}{\\IfBooleanTF{#1}{star}{plain}-#2-#3}%\n"
    docs = part_documents(spark, sf_dir, _say("\\begin{boxed}{@}@\\end{boxed} \\pick{@} \\pick*[o]{@}", "p_partkey", "p_name", "p_size", "p_size"), head)
    v = nodes.views(docs).select("doc_id", F.posexplode(F.split("view", "\n")).alias("n", "line")).filter("n > 0")
    return v.select(_big("doc_id"), _big("n"), "line")


def tex_expansion_chain(spark, sf_dir):
    """The expansion that each expansion stands in, and how deep it is."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\newcommand\\a{\\b\\b}\\newcommand\\b{\\c}\\newcommand\\c{@}\\a", "p_size").alias("text"))
    v = nodes.views(docs).select("doc_id", F.inline("expansions"))
    return v.groupBy("doc_id", "name", "depth").agg(F.count("*").alias("n"), F.count("parent_id").alias("within")).select(_big("doc_id", "p_partkey"), "name", _big("depth"), _big("n"), _big("within"))


def tex_joints(spark, sf_dir):
    """What must stand between what a macro writes and what follows."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\newcommand\\a{\\alpha}\\newcommand\\b{x@% note\n}\\a{}@ \\a x \\b y", "p_size", "p_partkey").alias("text"))
    v = nodes.views(docs)
    return v.select(_big("doc_id", "p_partkey"), F.substring_index("view", "}", -1).alias("tail"))


def tex_catcode_changes(spark, sf_dir):
    """Category codes that documents assign, and how the table then differs."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\catcode`\\%="), F.when(F.col("p_size") % 2 == 0, "12").otherwise("14"), F.lit(" a % b\n\\catcode"), (F.col("p_size") % 20 + 100).cast("string"), F.lit("=11 {\\catcode`\\@=11 \\x@y}\\x@y")).alias("text"))
    p = nodes.parse_once(docs)
    changed = nodes.differences(nodes.with_categories(nodes.changes(p))).groupBy("doc_id").agg(F.count("*").alias("changed"))
    said = nodes.nodes(p).groupBy("doc_id").agg(F.count_if(F.col("kind") == "comment").alias("comments"), F.count_if((F.col("kind") == "command") & (F.col("name") == "x@y")).alias("joined"))
    return nodes.changes(p).groupBy("doc_id").agg(F.count("*").alias("n")).join(sorted_side(changed), "doc_id", "left").join(sorted_side(said), "doc_id").select(_big("doc_id", "p_partkey"), _big("n"), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"), _big("comments"), _big("joined"))


def tex_carets(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("^^41@ ^^^^00e9 \\^^65mph{^^5c^^5c}", "p_size").alias("text"))
    n = nodes.nodes(nodes.parse(docs)).filter("node_id > 0 AND depth = 1")
    return n.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sib", F.concat("kind", F.lit(":"), F.when(F.col("kind") == "text", F.col("content")).otherwise(F.col("name"))).alias("t")))), lambda x: x["t"]), "|").alias("said")).select(_big("doc_id", "p_partkey"), "said")


def tex_follow_inputs(spark, sf_dir):
    """Documents know what the files that they include define, through others, by path; each chain is three files long."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    folder = F.concat(F.lit("d"), (F.col("p_partkey") % 7).cast("string"))
    main = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit(".tex")).alias("path"), F.concat(F.lit("\\input{../"), folder, F.lit("/a}\\documentclass{article}\\begin{document}\\bad\\end{document}")).alias("text"))
    shared = part.select((F.col("p_partkey") % 7).alias("k")).distinct()
    first = shared.select((-1 - F.col("k")).alias("doc_id"), F.format_string("d%d/a.tex", "k").alias("path"), F.lit("\\input{b}").alias("text"))
    second = shared.select((-101 - F.col("k")).alias("doc_id"), F.format_string("d%d/b.tex", "k").alias("path"), F.when(F.col("k") % 2 == 0, "\\newcommand\\bad{\\item x}").otherwise("\\newcommand\\bad{fine}").alias("text"))
    docs = main.unionByName(first).unionByName(second)
    return diagnostics.check(docs).filter("doc_id >= 0").select(_big("doc_id", "p_partkey"), "code", "message", _big("col"))


def tex_masters(spark, sf_dir):
    """The master document that each names, where it exists and is another."""
    part = _t(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.format_string("d/f%d.tex", "p_partkey").alias("path"), F.when(F.col("p_size") % 3 == 0, "no root").otherwise(F.concat(F.lit("\n% !TEX root = ./f"), F.when(F.col("p_size") % 3 == 1, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).cast("string"), F.lit("\nx"))).alias("text"))
    return documents.masters(docs).select(_big("doc_id", "p_partkey"), _big("master_id"))


def tex_trees(spark, sf_dir):
    """Packages found beside the document, or by name in a distribution's tree."""
    part = _t(spark, sf_dir, "part")
    wanted = part.select(F.col("p_partkey").alias("doc_id"), F.lit("d").alias("folder"), F.format_string("p%d", "p_size").alias("target"), F.lit(".sty").alias("extension"))
    files = part.filter("p_size % 4 = 0").select(F.format_string("d/p%d.sty", "p_size").alias("path"))
    trees = part.filter("p_size % 4 < 2").select(F.format_string("tree/x/p%d.sty", "p_size").alias("path"))
    return documents.resolved(wanted, files, trees).select(_big("doc_id", "p_partkey"), "path")


def tex_decoded(spark, sf_dir):
    """Bytes as text: UTF-8 with or without a mark, else Latin-1."""
    raw = F.when(F.col("p_size") % 3 == 0, F.encode(F.concat(F.lit("\ufeffé "), "p_name"), "UTF-8")).when(F.col("p_size") % 3 == 1, F.encode(F.concat(F.lit("é "), "p_name"), "UTF-8")).otherwise(F.encode(F.concat(F.lit("é "), "p_name"), "ISO-8859-1"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", raw.alias("content"))
    return rows.select(_big("p_partkey"), documents.encoding_of(F.col("content")).alias("encoding"), documents.decoded(F.col("content")).alias("text"))


def tex_missing_arguments(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("$\\frac"), F.repeat(F.lit("{x}"), (F.col("p_size") % 3).cast("int")), F.lit("$")).alias("text"))
    return tree.missing_arguments(nodes.nodes(nodes.parse(docs))).select(_big("doc_id", "p_partkey"), "name", _big("nth"))


def tex_enclosures(spark, sf_dir):
    """The groups around a command, the nearest first."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit("{\\begin{quote}"), (F.col("p_size") % 4).cast("int")), F.lit("$\\alpha$"), F.repeat(F.lit("\\end{quote}}"), (F.col("p_size") % 4).cast("int"))).alias("text"))
    n = nodes.nodes(nodes.parse_once(docs))
    got = tree.enclosures(n, n.filter(tree.is_command("alpha")))
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("name") == "quote").alias("quotes"), F.max(F.when(F.col("level") == 1, F.col("kind"))).alias("nearest")).select(_big("doc_id", "p_partkey"), _big("n"), _big("quotes"), "nearest")


def tex_same_content(spark, sf_dir):
    """Groups with equal content, wherever they stand."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("{a \\emph{@}}x{a  \\emph{@}}{a @}", "p_size", "p_size", "p_size").alias("text"))
    p = written(nodes.plain(docs, "node_id", "parent_id", "depth", "kind", "name", "content", "delimiter"), "plain")
    top = tree.same_content(p).join(sorted_side(nodes.nodes(p).filter("depth = 1 AND kind = 'brace'").select("doc_id", "node_id")), ["doc_id", "node_id"])
    return top.groupBy("doc_id").agg(F.count("*").alias("groups"), F.count_distinct("content_hash").alias("kinds")).select(_big("doc_id", "p_partkey"), _big("groups"), _big("kinds"))


def tex_order(spark, sf_dir):
    """Nodes by start, what encloses first."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("{{@}}\\emph{x}", "p_size").alias("text"))
    got = tree.in_order(nodes.nodes(nodes.parse(docs)).filter("node_id > 0"))
    return got.select(_big("doc_id", "p_partkey"), _big("place"), _big("depth"), "kind")


def tex_hierarchy(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\emph{@}$x$", "p_size").alias("text"))
    return tree.hierarchy(nodes.nodes(nodes.parse(docs))).select(_big("doc_id", "p_partkey"), "hierarchy")


def tex_outline_blocks(spark, sf_dir):
    """Blocks of all kinds and what holds them."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\section{@}\n\\begin{center}\n\\[x\\]\n\\end{center}\n\\iffalse no\\fi\\subsection{b}\n\\emph{a\nb}\\begin{verbatim}\nx\n\\end{verbatim}", "p_size").alias("text"))
    got = outline.blocks(nodes.parse_once(docs))
    outer = got.select("doc_id", F.col("block_id").alias("parent_id"), F.col("what").alias("within"))
    return got.join(sorted_side(outer), ["doc_id", "parent_id"], "left").select(_big("doc_id", "p_partkey"), "what", "label", _big("line"), F.coalesce("within", F.lit("none")).alias("within"))


def tex_outline_groups(spark, sf_dir):
    """Equal neighbours as one line with their number, long lines cut."""
    docs = part_documents(spark, sf_dir, F.concat(F.lit("\\section{"), F.when(F.col("p_partkey") % PART == 0, "first").otherwise("again"), F.lit("}")))
    p = nodes.parse(docs)
    return outline.outline(outline.section_blocks(p), outline.block_stats(p), depth=2, width=20, grouped=True).select(_big("doc_id"), "outline")


def tex_child_labels(spark, sf_dir):
    docs = part_documents(spark, sf_dir, F.concat(F.when(F.col("p_partkey") % PART == 0, "\\section{top} ").otherwise(""), F.lit("\\subsection{t"), (F.col("p_size") % 3).cast("string"), F.lit("}")))
    got = outline.child_labels(outline.section_blocks(nodes.parse(docs)))
    return got.select(_big("doc_id"), "label", _big("n"))


def tex_json(spark, sf_dir):
    """Diagnostics as JSON objects with file, end and suggestion."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("p/%d.tex", "p_partkey").alias("path"), _say("line\n\\emph{@", "p_size").alias("text"))
    return diagnostics.to_json(diagnostics.structure(nodes.parse(docs)), docs).select(_big("doc_id", "p_partkey"), "json")


def tex_rendered(spark, sf_dir):
    """Diagnostics with a window of a long line and a mark under the place."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit("."), F.lit(300)), F.lit("}"), F.repeat(F.lit("-"), F.col("p_size").cast("int"))).alias("text"))
    got = diagnostics.render_text(diagnostics.structure(nodes.parse(docs)).drop("fix"), docs)
    return got.select(_big("doc_id", "p_partkey"), "rendered")


def tex_messages(spark, sf_dir):
    """What codes report, in two languages."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, "a } b").otherwise("$x").alias("text"))
    found = diagnostics.structure(nodes.parse(docs))
    return messages.described(found, "fr").select(_big("doc_id", "p_partkey"), F.col("title").alias("fr")).join(messages.described(found, "en").select(_big("doc_id", "p_partkey"), F.col("title").alias("en")), "p_partkey")


def tex_projected(spark, sf_dir):
    """Diagnostics as an editor takes them, in its own units."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("x\n"), F.repeat(F.lit("\U0001f642é"), (F.col("p_size") % 4).cast("int")), F.lit("}")).alias("text"))
    return buffers.projected(diagnostics.structure(nodes.parse(docs)), docs).select(_big("doc_id", "p_partkey"), _big("severity"), _big("line"), _big("character"))


def tex_buffers(spark, sf_dir):
    """Only the newest text of each buffer counts; a closed one has nothing to say."""
    part = _t(spark, sf_dir, "part")
    events = part.select(F.format_string("u%d", F.col("p_partkey") % 40).alias("uri"), F.col("p_partkey").cast("long").alias("version"), F.when(F.col("p_size") % 5 == 0, "close").otherwise("change").alias("kind"), F.when(F.col("p_size") % 2 == 0, "a } b").otherwise("fine").alias("text"))
    return buffers.checked(events).select("uri", _big("version"), F.size("diagnostics").cast("long").alias("n"))


def tex_actions(spark, sf_dir):
    """Fixes of what overlaps a span."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit(" "), F.col("p_size").cast("int")), F.lit("x{y")).alias("text"))
    return edits.code_actions(diagnostics.structure(nodes.parse(docs)), 10, 20).select(_big("doc_id", "p_partkey"), _big("start"), "fix")


def tex_accents(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\'e\\`{a}\\c c\\\"{\\i} @\\ldots{} \\og x\\fg{} \\aa\\ss", "p_size").alias("text"))
    return nodes.prose(docs).select(_big("doc_id", "p_partkey"), "prose")


def tex_prose_formulas(spark, sf_dir):
    """Prose without formulas, notes at the end, references as stand-ins."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("a $x_{@}$ b\\footnote{n @} see \\ref{r}.", "p_size", "p_partkey").alias("text"))
    return nodes.prose(docs, math="skip").select(_big("doc_id", "p_partkey"), "prose")


def tex_quoted_search(spark, sf_dir):
    """A pattern with a reference of its own."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("ab \\emph{@@} cd", "p_size", "p_size").alias("text"))
    return nodes.search(nodes.prose(docs), r"(\d+)\1").select(_big("doc_id", "p_partkey"), "hit", _big("at"), _big("source"))


def tex_signatures(spark, sf_dir):
    """Commands of a table of one's own: stars, options, delimited and braced options."""
    table = signatures.table_lines(["\\probe any s o d() g m", "{frame} any o m"], signatures.builtin())
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\probe*"), F.when(F.col("p_size") % 2 == 0, "[o]").otherwise(""), F.when(F.col("p_size") % 3 == 0, "(d)").otherwise(""), F.lit("{g}{m}\\begin{frame}{t}x\\end{frame}")).alias("text"))
    got = tree.commands_arguments(nodes.parse(docs, table), ["probe"]).filter("nth > 0")
    return got.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "arg_kind"))), lambda x: F.concat(x["nth"].cast("string"), x["arg_kind"])), " ").alias("args")).select(_big("doc_id", "p_partkey"), "args")


def tex_images(spark, sf_dir):
    """Images that no file of the manifest fits, also without their extension, from the document's folder."""
    part = _t(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.lit("d/m.tex").alias("path"), _say("\\documentclass{a}\\begin{document}\\includegraphics{i@}\\end{document}", "p_size").alias("text"))
    files = part.filter("p_size % 3 <> 0").select(F.concat(F.lit("d/i"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 1, ".png").otherwise(".pdf")).alias("path"))
    return diagnostics.check(docs, files, follow_inputs=False).filter("code = 'file-not-found'").select(_big("doc_id", "p_partkey"), "severity", "message", _big("col"))


def tex_page(spark, sf_dir):
    """A page of a document's outline and source."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\section{<@>}\n}", "p_size").alias("text"))
    p = nodes.parse(docs)
    return outline.html_page(docs, outline.section_blocks(p), diagnostics.structure(p)).select(_big("doc_id", "p_partkey"), "page")


QUERIES = {f.__name__: f for f in (
    tex_sections, tex_arguments, tex_bound_arguments, tex_environments, tex_to_next, tex_lines_to_next, tex_preamble, tex_expansion, tex_provenance, tex_unclosed, tex_meaning, tex_summary,
    tex_too_many_columns, tex_delimiters, tex_equation_labels, tex_definitions, tex_lengths, tex_missing_files, tex_typos, tex_check_expanded, tex_edits, tex_quick_fixes, tex_prose, tex_search, tex_outline,
    tex_catcodes, tex_verbatim, tex_lines, tex_comments, tex_environment_tally, tex_fingerprints, tex_walk,
    tex_conditionals, tex_expansion_environments, tex_expansion_chain, tex_joints, tex_catcode_changes, tex_carets, tex_follow_inputs,
    tex_masters, tex_trees, tex_decoded, tex_missing_arguments, tex_enclosures, tex_same_content, tex_order,
    tex_hierarchy, tex_outline_blocks, tex_outline_groups, tex_child_labels, tex_json, tex_rendered, tex_messages,
    tex_projected, tex_buffers, tex_actions, tex_accents, tex_prose_formulas, tex_quoted_search, tex_signatures,
    tex_images, tex_page,
)}
QUERIES |= rules.QUERIES | structure.QUERIES | views.QUERIES | changes.QUERIES
FLAGSHIP = tex_sections

_P = f"(p_partkey // {PART})::BIGINT AS doc_id"
_NTH = f"row_number() OVER (PARTITION BY p_partkey // {PART} ORDER BY p_partkey)::BIGINT"
ORACLE_SQL = {
    "tex_sections": f"SELECT {_P}, p_name AS title, {_NTH} AS line, 0::BIGINT AS col FROM part",
    "tex_arguments": f"SELECT {_P}, 1::BIGINT AS nth, 'option' AS arg_kind, 'width=' || p_size AS argument FROM part UNION ALL SELECT {_P}, 2::BIGINT, 'brace', 'p/' || p_partkey FROM part",
    "tex_bound_arguments": f"SELECT {_P}, k::BIGINT AS nth, 1::BIGINT AS size, {_NTH} AS line FROM part, (SELECT 1 AS k UNION ALL SELECT 2) QUALIFY true".replace(_NTH, f"dense_rank() OVER (PARTITION BY p_partkey // {PART} ORDER BY p_partkey)::BIGINT").replace(" QUALIFY true", ""),
    "tex_environments": "SELECT l_orderkey::BIGINT AS l_orderkey, (count(*) + 2)::BIGINT AS last_line, count(*)::BIGINT AS items FROM lineitem GROUP BY l_orderkey",
    "tex_to_next": f"SELECT {_P}, (2 + 2 * (p_size % 4))::BIGINT AS n, (1 + 2 * (p_size % 4))::BIGINT AS \"last\" FROM part",
    "tex_lines_to_next": f"SELECT {_P}, {_NTH} AS nth, (1 + p_size % 3)::BIGINT AS n_lines, p_name AS title FROM part",
    "tex_preamble": f"SELECT {_P}, 2::BIGINT AS commands, count(*)::BIGINT AS inputs FROM part GROUP BY ALL",
    "tex_expansion": f"SELECT {_P}, {_NTH} AS n, p_name || ' in ' || p_size || ' cm' AS line FROM part",
    "tex_provenance": f"SELECT {_P}, '\\name{{' || p_partkey || '}}' AS used, 1::BIGINT AS depth FROM part",
    "tex_unclosed": "SELECT p_partkey::BIGINT AS p_partkey, 'unclosed-brace' AS code, 1::BIGINT AS line, 5::BIGINT AS col, (6 + length(rtrim(p_name)))::BIGINT AS fix_at, '}' AS fix FROM part WHERE p_size % 7 = 0",
    "tex_meaning": """SELECT p_partkey::BIGINT AS p_partkey, ['item-outside-list', 'ampersand-outside-alignment', 'script-outside-math', 'caption-outside-float', 'preamble-only'][p_size % 6 + 1] AS code, 'error' AS severity, 3::BIGINT AS line, 0::BIGINT AS col FROM part WHERE p_size % 6 < 5""",
    "tex_summary": "SELECT 'warning' AS severity, 'unclosed-math' AS code, count(*)::BIGINT AS n FROM part WHERE p_size % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'error', 'extra-brace', count(*)::BIGINT FROM part WHERE p_size % 5 = 0 HAVING count(*) > 0",
    "tex_too_many_columns": f"SELECT * FROM (SELECT {_P}, {_NTH} + 1 AS line, (p_size % 5 + 1) || ' cells in a row of 3 columns' AS message, p_size FROM part) WHERE p_size % 5 + 1 > 3".replace("SELECT * FROM", "SELECT doc_id, line, message FROM"),
    "tex_delimiters": "SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 4 = 0 THEN 'right-without-left' ELSE 'left-without-right' END AS code, CASE WHEN p_size % 4 = 0 THEN 3 ELSE 1 END::BIGINT AS col FROM part WHERE p_size % 4 < 2",
    "tex_equation_labels": "SELECT p_partkey::BIGINT AS p_partkey, 'multiple-labels' AS code, (2 + k)::BIGINT AS line FROM part, (SELECT 1 AS k UNION ALL SELECT 2) WHERE k < p_size % 4",
    "tex_definitions": "SELECT p_partkey::BIGINT AS p_partkey, 'illegal-parameter' AS code, 'parameter 2 of ' || (p_size % 4) AS message FROM part WHERE p_size % 4 < 2",
    "tex_lengths": "SELECT p_partkey::BIGINT AS p_partkey, 'invalid-length' AS code FROM part WHERE p_size % 5 IN (1, 3)",
    "tex_missing_files": "SELECT p_partkey::BIGINT AS p_partkey, 'warning' AS severity, './p/' || p_partkey || ' is not found' AS message FROM part WHERE p_partkey % 3 = 0",
    "tex_typos": r"SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 3 = 1 THEN '\setcion: did you mean \section?' ELSE '\sectiom: did you mean \section?' END AS message, 0::BIGINT AS col FROM part WHERE p_size % 3 <> 0",
    "tex_check_expanded": r"SELECT p_partkey::BIGINT AS p_partkey, 'item-outside-list' AS code, 'an item outside a list (written by \bad)' AS message, 3::BIGINT AS line, 0::BIGINT AS col FROM part WHERE p_size % 2 = 0",
    "tex_edits": f"SELECT {_P}, {_NTH} - 1 AS n, '\\subsection{{' || p_name || '}} ' || p_brand AS line FROM part",
    "tex_quick_fixes": r"SELECT p_partkey::BIGINT AS p_partkey, '\emph{' || p_name || '}' AS text FROM part",
    "tex_prose": "SELECT p_partkey::BIGINT AS p_partkey, p_name || chr(10) || chr(10) || p_brand || ' ' || p_size || ' and more' AS prose FROM part",
    "tex_search": "SELECT p_partkey::BIGINT AS p_partkey, 1::BIGINT AS nth, 'size' AS hit, 0::BIGINT AS at, 8::BIGINT AS source FROM part UNION ALL SELECT p_partkey::BIGINT, 2::BIGINT, 'size', (9 + length(p_size::VARCHAR))::BIGINT, (24 + length(p_size::VARCHAR))::BIGINT FROM part",
    "tex_outline": f"""WITH p AS (SELECT {_P}, p_partkey, p_size % 4 + 1 AS w, {_NTH} AS line, p_partkey % 5 = 0 AS top, sum((p_partkey % 5 = 0)::INT) OVER (PARTITION BY p_partkey // {PART} ORDER BY p_partkey) AS s FROM part)
SELECT a.doc_id, 's' AS label, a.line, sum(b.w)::BIGINT AS words FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.s = b.s WHERE a.top GROUP BY ALL
UNION ALL SELECT doc_id, 't', line, w::BIGINT FROM p WHERE NOT top""",
    "tex_catcodes": "SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a@b' ELSE 'a' END AS name, CASE WHEN p_size % 2 = 0 THEN 13 ELSE 15 END::BIGINT AS col FROM part",
    "tex_verbatim": "SELECT p_partkey::BIGINT AS p_partkey, 'verb' AS name, p_name || '{' AS content FROM part UNION ALL SELECT p_partkey::BIGINT, 'verbatim', chr(10) || '%$' || p_size || chr(10) FROM part",
    "tex_lines": "SELECT doc_id::BIGINT AS doc_id, k::BIGINT AS line, length(l[k])::BIGINT AS size FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')) WHERE k < len(l) OR l[k] <> ''",
    "tex_comments": "SELECT doc_id::BIGINT AS doc_id, k::BIGINT AS line, (instr(l[k], '%') - 1)::BIGINT AS col, substr(l[k], instr(l[k], '%') + 1) AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE instr(l[k], '%') > 0",
    "tex_environment_tally": "SELECT 'quote' AS name, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'center', count(DISTINCT l_orderkey)::BIGINT FROM lineitem",
    "tex_fingerprints": "SELECT p_partkey::BIGINT AS p_partkey, ['added', 'removed', 'changed', 'same'][p_size % 4 + 1] AS state FROM part",
    "tex_walk": "SELECT l_orderkey::BIGINT AS l_orderkey, w AS what, count(*)::BIGINT AS n FROM lineitem, (SELECT 'open' AS w UNION ALL SELECT 'leaf' UNION ALL SELECT 'close') GROUP BY ALL",
    "tex_conditionals": "SELECT p_partkey::BIGINT AS p_partkey, 4::BIGINT AS n, 1::BIGINT AS taken, p_size >= 25 AS second FROM part",
    "tex_expansion_environments": f"SELECT {_P}, {_NTH} AS n, '<d:' || p_partkey || '|' || p_name || '|> plain-def-' || p_size || ' star-o-' || p_size AS line FROM part",
    "tex_expansion_chain": "SELECT p_partkey::BIGINT AS p_partkey, v.name, v.depth::BIGINT AS depth, v.n::BIGINT AS n, v.within::BIGINT AS within FROM part, (VALUES ('a', 1, 1, 0), ('b', 2, 2, 2), ('c', 3, 2, 2)) AS v(name, depth, n, within)",
    "tex_joints": r"SELECT p_partkey::BIGINT AS p_partkey, p_partkey || ' \alpha x x' || p_size || '% note' || chr(10) || ' y' AS tail FROM part",
    "tex_catcode_changes": "SELECT p_partkey::BIGINT AS p_partkey, 3::BIGINT AS n, (CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END)::BIGINT AS changed, (CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END)::BIGINT AS comments, 1::BIGINT AS joined FROM part",
    "tex_carets": "SELECT p_partkey::BIGINT AS p_partkey, 'text:A' || p_size || ' é|command:emph|brace:{' AS said FROM part",
    "tex_follow_inputs": r"SELECT p_partkey::BIGINT AS p_partkey, 'item-outside-list' AS code, 'an item outside a list (written by \bad)' AS message, 54::BIGINT AS col FROM part WHERE (p_partkey % 7) % 2 = 0",
    "tex_masters": "SELECT p_partkey::BIGINT AS p_partkey, (p_partkey - 1)::BIGINT AS master_id FROM part WHERE p_size % 3 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part)",
    "tex_trees": "SELECT p_partkey::BIGINT AS p_partkey, CASE p_size % 4 WHEN 0 THEN 'd/p' || p_size || '.sty' WHEN 1 THEN 'tree/x/p' || p_size || '.sty' END AS path FROM part",
    "tex_decoded": "SELECT p_partkey::BIGINT AS p_partkey, ['utf-8-sig', 'utf-8', 'latin-1'][p_size % 3 + 1] AS encoding, 'é ' || p_name AS text FROM part",
    "tex_missing_arguments": "SELECT p_partkey::BIGINT AS p_partkey, 'frac' AS name, v.k::BIGINT AS nth FROM part, (VALUES (1), (2)) AS v(k) WHERE v.k > p_size % 3",
    "tex_enclosures": "SELECT p_partkey::BIGINT AS p_partkey, (1 + 2 * (p_size % 4))::BIGINT AS n, (p_size % 4)::BIGINT AS quotes, 'math' AS nearest FROM part",
    "tex_same_content": "SELECT p_partkey::BIGINT AS p_partkey, 3::BIGINT AS \"groups\", 2::BIGINT AS kinds FROM part",
    "tex_order": "SELECT p_partkey::BIGINT AS p_partkey, v.place::BIGINT AS place, v.depth::BIGINT AS depth, v.kind FROM part, (VALUES (1, 1, 'brace'), (2, 2, 'brace'), (3, 3, 'text'), (4, 1, 'command'), (5, 1, 'brace'), (6, 2, 'text')) AS v(place, depth, kind)",
    "tex_hierarchy": r"SELECT p_partkey::BIGINT AS p_partkey, '\emph' || chr(10) || 'brace {' || chr(10) || '  ''' || p_size || '''' || chr(10) || '$' || chr(10) || '  ''x''' AS hierarchy FROM part",
    "tex_outline_blocks": r"SELECT p_partkey::BIGINT AS p_partkey, v.what, CASE WHEN v.label = '@' THEN p_size::VARCHAR ELSE v.label END AS label, v.line::BIGINT AS line, v.within FROM part, (VALUES ('section', '@', 1, 'none'), ('environment', 'center', 2, 'section'), ('math', '\[', 3, 'environment'), ('discarded', 'iffalse', 5, 'section'), ('section', 'b', 5, 'section'), ('command', 'emph', 6, 'section'), ('verbatim', 'verbatim', 7, 'section')) AS v(what, label, line, within)",
    "tex_outline_groups": f"SELECT doc_id, CASE WHEN f = 1 THEN '    first (0 words)' ELSE '' END || CASE WHEN f = 1 AND n > 1 THEN chr(10) ELSE '' END || CASE WHEN n = f THEN '' WHEN n - f = 1 THEN '    again (0 words)' ELSE '    again (0 words)…' END AS outline FROM (SELECT {_P}, count(*) AS n, sum((p_partkey % {PART} = 0)::INT) AS f FROM part GROUP BY 1)",
    "tex_child_labels": f"SELECT {_P}, 't' || (p_size % 3) AS label, count(*)::BIGINT AS n FROM part WHERE p_partkey // {PART} IN (SELECT p_partkey // {PART} FROM part WHERE p_partkey % {PART} = 0) GROUP BY 1, 2",
    "tex_json": """SELECT p_partkey::BIGINT AS p_partkey, '{"file":"p/' || p_partkey || '.tex","line":2,"column":6,"severity":"warning","code":"unclosed-brace","message":"{ is not closed before end of file","suggestion":"put in }","end_line":2,"end_column":7}' AS json FROM part""",
    "tex_rendered": "SELECT p_partkey::BIGINT AS p_partkey, '1:301: error [extra-brace] this brace closes nothing' || chr(10) || repeat('.', 300 - greatest(0, least(275, 201 + p_size))) || '}' || repeat('-', least(p_size, 99 - (300 - greatest(0, least(275, 201 + p_size))))) || chr(10) || repeat(' ', 300 - greatest(0, least(275, 201 + p_size))) || '^' AS rendered FROM part",
    "tex_messages": "SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 2 = 0 THEN 'une accolade ne ferme rien' ELSE 'une formule n''est jamais fermée' END AS fr, CASE WHEN p_size % 2 = 0 THEN 'a brace closes nothing' ELSE 'a formula is never closed' END AS en FROM part",
    "tex_projected": "SELECT p_partkey::BIGINT AS p_partkey, 1::BIGINT AS severity, 1::BIGINT AS line, (3 * (p_size % 4))::BIGINT AS character FROM part",
    "tex_buffers": "SELECT 'u' || (p_partkey % 40) AS uri, p_partkey::BIGINT AS version, (CASE WHEN p_size % 5 <> 0 AND p_size % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM part WHERE p_partkey IN (SELECT max(p_partkey) FROM part GROUP BY p_partkey % 40)",
    "tex_actions": "SELECT p_partkey::BIGINT AS p_partkey, (p_size + 1)::BIGINT AS start, '}' AS fix FROM part WHERE p_size + 1 <= 20 AND p_size + 2 >= 10",
    "tex_accents": "SELECT p_partkey::BIGINT AS p_partkey, 'éàçï ' || p_size || '… « x » åß' AS prose FROM part",
    "tex_prose_formulas": "SELECT p_partkey::BIGINT AS p_partkey, 'a b see ?.' || chr(10) || chr(10) || 'n ' || p_partkey AS prose FROM part",
    "tex_quoted_search": "SELECT p_partkey::BIGINT AS p_partkey, p_size::VARCHAR || p_size AS hit, 3::BIGINT AS at, 9::BIGINT AS source FROM part",
    "tex_signatures": "SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 2 = 0 THEN '1option ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '2text ' ELSE '' END || '3brace 4brace' AS args FROM part",
    "tex_images": "SELECT p_partkey::BIGINT AS p_partkey, 'error' AS severity, 'i' || p_size || ' is not found' AS message, 33::BIGINT AS col FROM part WHERE p_size % 3 = 0",
    "tex_page": r"""SELECT p_partkey::BIGINT AS p_partkey, '<!doctype html><meta charset=utf-8><nav><ul>' || chr(10) || '<li class="level2"><a href="#l1">&lt;' || p_size || '&gt;</a></li>' || chr(10) || '</ul></nav><main><ol>' || chr(10) || '<li id="l1">\section{&lt;' || p_size || '&gt;}</li>' || chr(10) || '<li id="l2">}<span class="error">this brace closes nothing</span></li>' || chr(10) || '</ol></main>' AS page FROM part""",
}
ORACLE_SQL |= rules.ORACLE_SQL | structure.ORACLE_SQL | views.ORACLE_SQL | changes.ORACLE_SQL
