"""Queries over trees: overlapping segments, visits and folds, rewritten text, titles, paths, and what reports them; with the SQL that states their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import diagnostics, folds, nodes, outline, tree
from scriptorium.plans.documents import PART, _big, _say, _t, _tasks, part_documents
from scriptorium.sources import documents
from scriptorium.streaming import buffers
from scriptorium.tables import sorted_side


def tex_overlapping(spark, sf_dir):
    """Each chapter with all that follows it in its group: segments overlap."""
    docs = part_documents(spark, sf_dir, F.concat(F.repeat(F.lit("x % c\n"), (F.col("p_size") % 3).cast("int")), _say("\\chapter{@}", "p_partkey")))
    told = nodes.plain(docs, "node_id", "parent_id", "sib", "kind", "name", "start", "stop", "bare")
    # Dealt by document once and for all, to so many tasks: sizes of shuffled nodes are told packed, and tasks put together by them hold many times that.
    dealt = nodes.nodes(told).repartition(_tasks(spark), "doc_id")
    got = tree.commands_to_next(dealt, "chapter", close_at_same_level=False)
    said = got.groupBy("doc_id", "head").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "command").alias("chapters"), F.count_if(F.col("kind") == "comment").alias("comments"))
    return said.select(_big("doc_id"), _big("n"), _big("chapters"), _big("comments"))


def tex_visits(spark, sf_dir):
    """What a visit says of every command, from itself, its place and its group."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\alpha{@ \\beta}[\\gamma \\delta]", "p_size").alias("text"))
    got = folds.map_contents(nodes.parse(docs), lambda n, index, parent: F.when(n["kind"] == "command", F.concat(n["name"], F.lit(" "), index.cast("string"), F.lit(" in "), parent["name"])))
    return got.select(_big("doc_id", "p_partkey"), "found")


def tex_group_visits(spark, sf_dir):
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("{@}\\begin{quote}$x$ \\verb|@|\\end{quote}", "p_size", "p_name").alias("text"))
    got = folds.map_groups(nodes.parse(docs), lambda n: F.concat(n["kind"], F.lit(":"), F.when(n["kind"] == "verbatim", n["content"]).otherwise(n["name"])))
    return got.select(_big("doc_id", "p_partkey"), "found")


def tex_fold(spark, sf_dir):
    """A value from the leaves up: how deep each group is, and how much ink it holds."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit("{"), (F.col("p_size") % 5).cast("int")), F.col("p_brand"), F.repeat(F.lit("}"), (F.col("p_size") % 5).cast("int")), F.lit(" {a}b")).alias("text"))
    p = nodes.parse_once(docs)
    deep = folds.folded(p, type="int", empty=F.lit(0), leaf=lambda n: F.lit(0), join=lambda value, rest: F.greatest(value, rest), group=lambda n, inner: inner + 1).filter("node_id = 0").withColumnRenamed("value", "deep")
    ink = folds.folded(p, type="int", empty=F.lit(0), leaf=lambda n: F.length(n["content"]), join=lambda value, rest: value + rest, group=lambda n, inner: inner).filter("node_id = 0").withColumnRenamed("value", "ink")
    return deep.join(sorted_side(ink), "doc_id").select(_big("doc_id", "p_partkey"), _big("deep"), _big("ink"))


def tex_rewritten(spark, sf_dir):
    """The text that nodes write: blanks as places say, all else the same."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\begin{quote}  { @}\\emph{@}%  note\n   x\t$ @ $\n\n \n\\verb|a  b| \\[ \\]\\end{quote} ", "p_size", "p_size", "p_partkey").alias("text"))
    return tree.rewritten(nodes.parse(docs)).select(_big("doc_id", "p_partkey"), "rewritten")


def tex_rewritten_alike(spark, sf_dir):
    """Rewritten documents have the same nodes: content digests of both readings agree, group by group."""
    docs = part_documents(spark, sf_dir, _say("\\section[@]{@  of  @}\n\n\\begin{itemize}  \\item $ a_{@} $ % @\n \\end{itemize}", "p_size", "p_name", "p_type", "p_size", "p_brand"))
    p = nodes.parse_once(docs)
    again = nodes.parse(tree.rewritten(p).select("doc_id", F.col("rewritten").alias("text")))
    before, after = folds.content_hashes(p), folds.content_hashes(again).withColumnRenamed("content_hash", "again")
    same = before.join(sorted_side(after), ["doc_id", "node_id"], "full").groupBy("doc_id").agg(F.bool_and(F.col("content_hash").eqNullSafe(F.col("again"))).alias("same"))
    return same.select(_big("doc_id"), "same")


def tex_short_titles(spark, sf_dir):
    docs = part_documents(spark, sf_dir, F.concat(F.lit("\\section"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("[s"), F.col("p_size").cast("string"), F.lit("]"))).otherwise(""), _say("{@}", "p_name")))
    return tree.sections(nodes.parse(docs)).select(_big("doc_id"), "title", "short", _big("line"))


def tex_paths(spark, sf_dir):
    """Paths without what goes nowhere, however often it goes back."""
    back = F.repeat(F.lit("../"), (F.col("p_size") % 5).cast("int"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a/./b//c/"), back, F.lit("d.tex")).alias("p"), F.concat(F.lit("file:/a/b/"), back, F.lit("d")).alias("q"))
    return rows.select(_big("p_partkey"), documents.normalized(F.col("p")).alias("path"), documents.normalized(F.col("q")).alias("rooted"))


def tex_far_inputs(spark, sf_dir):
    """Files two folders up are found, and what they define is known."""
    part = _t(spark, sf_dir, "part")
    main = part.select(F.col("p_partkey").alias("doc_id"), F.format_string("p%d/q/main.tex", "p_partkey").alias("path"), F.when(F.col("p_size") % 2 == 0, "\\input{../../c}\\bad").otherwise("\\input{.././../p/../none} fine").alias("text"))
    shared = spark.createDataFrame([(-1, "c.tex", "\\newcommand\\bad{\\item x}")], "doc_id long, path string, text string")
    docs = main.unionByName(shared)
    found = diagnostics.check(docs.withColumn("text", F.when(F.col("doc_id") < 0, F.col("text")).otherwise(F.concat(F.lit("\\documentclass{article}\\begin{document}"), "text", F.lit("\\end{document}")))), docs.select("path"))
    return found.select(_big("doc_id", "p_partkey"), "code", "message")


def tex_ranked_trees(spark, sf_dir):
    """Names looked for in several trees: the first that has one answers, also by folders; a path that says where it is asks no tree."""
    part = _t(spark, sf_dir, "part")
    target = F.when(F.col("p_size") % 4 == 0, F.format_string("sub/p%d", "p_size")).when(F.col("p_size") % 4 == 1, F.format_string("./p%d", "p_size")).otherwise(F.format_string("p%d", "p_size"))
    wanted = part.select(F.col("p_partkey").alias("doc_id"), F.lit("d").alias("folder"), target.alias("target"), F.lit(".sty").alias("extension"))
    files = part.filter("p_size % 4 = 2 AND p_size % 3 = 0").select(F.format_string("d/p%d.sty", "p_size").alias("path"))
    trees = part.select(F.format_string("z/own/sub/p%d.sty", "p_size").alias("path"), F.lit(0).alias("rank")).filter("p_size % 3 < 2").unionByName(part.select(F.format_string("a/dist/sub/p%d.sty", "p_size").alias("path"), F.lit(1).alias("rank")))
    return documents.resolved(wanted, files, trees).select(_big("doc_id", "p_partkey"), "path")


def tex_json_checked(spark, sf_dir):
    """The whole way from documents of many lengths to JSON: places and ends are those of each document's own lines."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.format_string("p/%d.tex", "p_partkey").alias("path"), F.concat(F.repeat(F.lit("line\n"), (F.col("p_size") % 13).cast("int")), F.repeat(F.lit("."), (F.col("p_partkey") % 7).cast("int")), F.lit("}\nend")).alias("text"))
    return diagnostics.to_json(diagnostics.check(docs), docs).select(_big("doc_id", "p_partkey"), "json")


def tex_block_statistics(spark, sf_dir):
    """What each section holds, with notable commands and discarded branches, the most common first."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\label{a}\\section{s} one two"), F.repeat(F.lit("\\cite{c}"), (F.col("p_size") % 3).cast("int")), F.lit("\\ref{r}\\ref{r} \\iffalse no\\fi $x$")).alias("text"))
    got = outline.top_stats(outline.block_stats(nodes.parse_once(docs)), 2)
    return got.select(_big("doc_id", "p_partkey"), F.least("block_id", F.lit(2)).cast("long").alias("block"), "key", _big("n"), _big("nth"))


RELATED = (
    "Rows @ \\begin{center} a & b \\end{center}", "\\begin{equation} x \\label{a@} + y \\label{b@} \\end{equation}", "\\[ @ + \\footnote{n} \\]", "\\newcommand\\mine{@} and \\newcommand\\mine{again}", "$ a @ \\left( b $", "\\textit{@ first\n\nsecond}", "\\begin{tabular}{l} @ & b \\end{tabular}",
)


def related_documents(spark, sf_dir):
    shapes = F.array(*(F.lit("\\documentclass{article}\n\\begin{document}\n" + t + "\n\\end{document}\n") for t in RELATED))
    part = _t(spark, sf_dir, "part").withColumn("t", F.element_at(shapes, (F.col("p_partkey") % len(RELATED) + 1).cast("int")))
    return part.select(F.col("p_partkey").alias("doc_id"), F.replace("t", F.lit("@"), F.col("p_size").cast("string")).alias("text"))


def tex_related(spark, sf_dir):
    """What explains each report: the opening around it, or the first of two."""
    found = diagnostics.check(related_documents(spark, sf_dir)).select("doc_id", "code", F.inline("related"))
    return found.select(_big("doc_id", "p_partkey"), "code", "message", _big("line"), _big("col"), _big("end_col"))


def tex_related_shown(spark, sf_dir):
    """Related places in text, in JSON and for an editor."""
    docs = related_documents(spark, sf_dir).filter(f"doc_id % {len(RELATED)} = 0")
    found = diagnostics.check(docs)
    text = diagnostics.render_text(found, docs).select("doc_id", "rendered")
    told = diagnostics.to_json(found, docs).select("doc_id", F.get_json_object("json", "$.related").alias("json"))
    editor = buffers.projected(found, docs).select("doc_id", F.to_json("related").alias("editor"))
    return text.join(sorted_side(told), "doc_id").join(sorted_side(editor), "doc_id").select(_big("doc_id", "p_partkey"), "rendered", "json", "editor")


NAMES = (
    "\\includegraphics{no_@}", "\\includegraphics[width=@mm,trim=1_2]{no_@.png}", "\\url{http://x/a_@&b}", "\\href{http://x/a_@}{here}", "\\input{part_@}", "\\cite{who_@}", "\\cite[p. @]{who_a,who_b}", "\\bibliography{all_@}", "\\bibliographystyle{my_@}", "\\pagestyle{my_@}",
    "\\ensuremath{x_@}", "\\label{a_@}\\ref{a_@}", "\\hyperref[a_@]{there}", "\\setlength{\\parskip}{\\dimexpr @pt+1cm\\relax}", "\\begin{itemize}[label=a_@]\\item x\\end{itemize}", "\\textcolor{my_@}{x}", "\\setcounter{my_c}{@}", "\\footnote{See \\url{a_@}.}", "\\nocite{*}\\addbibresource{a_@.bib}", "\\usetikzlibrary{a_@}\\color{my_@}",
)
LOUD = ("\\href{http://x}{a_@}", "\\textcolor{red}{a_@}", "\\section{a_@}", "\\footnote{a_@ \\url{b_c}}")


def tex_names(spark, sf_dir):
    """Everyday constructs whose arguments are names, paths or keys are silent; the prose beside them isn't."""
    shapes = F.array(*(F.lit("\\documentclass{article}\\usepackage{enumitem,graphicx,hyperref,xcolor,tikz,biblatex}\\begin{document}\n" + t + "\n\\end{document}\n") for t in (*NAMES, *LOUD)))
    part = _t(spark, sf_dir, "part").withColumn("t", F.element_at(shapes, (F.col("p_partkey") % (len(NAMES) + len(LOUD)) + 1).cast("int")))
    found = diagnostics.check(part.select(F.col("p_partkey").alias("doc_id"), F.replace("t", F.lit("@"), F.col("p_size").cast("string")).alias("text"))).filter("severity <> 'info'")
    return found.groupBy("doc_id", "code").agg(F.count("*").alias("n")).select(_big("doc_id", "p_partkey"), "code", "n")


QUERIES = {f.__name__: f for f in (tex_overlapping, tex_visits, tex_group_visits, tex_fold, tex_rewritten, tex_rewritten_alike, tex_short_titles, tex_paths, tex_far_inputs, tex_ranked_trees, tex_json_checked, tex_block_statistics, tex_related, tex_related_shown, tex_names)}

_P = f"(p_partkey // {PART})::BIGINT AS doc_id"
_NTH = f"row_number() OVER (PARTITION BY p_partkey // {PART} ORDER BY p_partkey)::BIGINT"
_BACK = "p_size % 5"
ORACLE_SQL = {
    "tex_overlapping": f"SELECT doc_id, (sum(2 + t) OVER w - t)::BIGINT AS n, (count(*) OVER w)::BIGINT AS chapters, 0::BIGINT AS comments FROM (SELECT {_P}, p_partkey, p_size % 3 AS t FROM part) WINDOW w AS (PARTITION BY doc_id ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "tex_visits": "SELECT p_partkey::BIGINT AS p_partkey, v.found FROM part, (VALUES ('alpha 0 in root'), ('beta 1 in {'), ('gamma 0 in ['), ('delta 1 in [')) AS v(found)",
    "tex_group_visits": "SELECT p_partkey::BIGINT AS p_partkey, CASE v.k WHEN 0 THEN 'brace:{' WHEN 1 THEN 'environment:quote' WHEN 2 THEN 'math:$' ELSE 'verbatim:' || p_name END AS found FROM part, (VALUES (0), (1), (2), (3)) AS v(k)",
    "tex_fold": "SELECT p_partkey::BIGINT AS p_partkey, (1 + greatest(1, p_size % 5))::BIGINT AS deep, (length(p_brand) + 2)::BIGINT AS ink FROM part",
    "tex_rewritten": r"SELECT p_partkey::BIGINT AS p_partkey, '\begin{quote} { ' || p_size || '}\emph{' || p_size || '}%  note' || chr(10) || 'x $ ' || p_partkey || ' $' || chr(10) || chr(10) || '\verb|a  b| \[ \]\end{quote}' AS rewritten FROM part",
    "tex_rewritten_alike": f"SELECT DISTINCT {_P}, true AS same FROM part",
    "tex_short_titles": f"SELECT {_P}, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 's' || p_size END AS short, {_NTH} AS line FROM part",
    "tex_paths": f"SELECT p_partkey::BIGINT AS p_partkey, ['a/b/c/d.tex', 'a/b/d.tex', 'a/d.tex', 'd.tex', '../d.tex'][{_BACK} + 1] AS path, ['file:/a/b/d', 'file:/a/d', 'file:/d', 'file:/d', 'file:/d'][{_BACK} + 1] AS rooted FROM part",
    "tex_far_inputs": r"SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 2 = 0 THEN 'item-outside-list' ELSE 'file-not-found' END AS code, CASE WHEN p_size % 2 = 0 THEN 'an item outside a list (written by \bad)' ELSE '.././../p/../none is not found' END AS message FROM part",
    "tex_ranked_trees": "SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 4 = 2 AND p_size % 3 = 0 THEN 'd/p' || p_size || '.sty' WHEN p_size % 3 < 2 THEN 'z/own/sub/p' || p_size || '.sty' ELSE 'a/dist/sub/p' || p_size || '.sty' END AS path FROM part",
    "tex_json_checked": """SELECT p_partkey::BIGINT AS p_partkey, '{"file":"p/' || p_partkey || '.tex","line":' || l || ',"column":' || c || ',"severity":"error","code":"extra-brace","message":"this brace closes nothing","related":[],"end_line":' || l || ',"end_column":' || (c + 1) || '}' AS json FROM (SELECT p_partkey, p_size % 13 + 1 AS l, p_partkey % 7 + 1 AS c FROM part)""",
    "tex_block_statistics": r"""SELECT p_partkey::BIGINT AS p_partkey, v.block::BIGINT AS block, v.key, (CASE WHEN v.key = '\cite' THEN c ELSE v.n END)::BIGINT AS n, v.nth::BIGINT AS nth FROM (SELECT p_partkey, p_size % 3 AS c FROM part) p, (VALUES
  (0, 0, '\label', 1, 1), (0, 2, 'words', 2, 1), (0, 2, '\ref', 2, 2), (0, 2, 'discarded', 1, 3),
  (1, 0, '\label', 1, 1), (1, 2, 'words', 2, 1), (1, 2, '\ref', 2, 2), (1, 2, '\cite', 1, 3),
  (2, 0, '\label', 1, 1), (2, 2, 'words', 2, 1), (2, 2, '\cite', 2, 2), (2, 2, '\ref', 2, 3)) AS v(k, block, key, n, nth) WHERE v.k = p.c""",
    "tex_related": r"""SELECT p_partkey::BIGINT AS p_partkey, v.code, v.message, 3::BIGINT AS line, (v.col + v.moves * length(p_size::VARCHAR))::BIGINT AS col, (v.col + v.moves * length(p_size::VARCHAR) + v.size + v.grows * length(p_size::VARCHAR))::BIGINT AS end_col FROM part JOIN (VALUES
  (0, 'ampersand-outside-alignment', 'the environment here aligns nothing', 6, 1, 14, 0), (1, 'multiple-labels', 'the first label is here', 19, 0, 6, 0), (2, 'invalid-in-math', 'the formula is opened here', 0, 0, 2, 0),
  (3, 'already-defined', 'the first definition is here', 0, 0, 11, 0), (4, 'left-without-right', 'the group ends here', 14, 1, 1, 0), (5, 'blank-line-in-argument', 'the argument belongs to this command', 0, 0, 7, 0), (6, 'too-many-columns', 'the columns are set here', 0, 0, 15, 0)
) AS v(k, code, message, col, moves, size, grows) ON p_partkey % 7 = v.k""",
    "tex_related_shown": r"""SELECT p_partkey::BIGINT AS p_partkey, '3:' || (21 + d + 1) || ': error [ampersand-outside-alignment] an alignment mark outside an alignment' || chr(10) || src || chr(10) || repeat(' ', 21 + d) || '^~~~~' || chr(10) || src || chr(10) || repeat(' ', 6 + d) || '^~~~~~~~~~~~~~ the environment here aligns nothing' AS rendered,
  '[{"line":3,"column":' || (7 + d) || ',"end_line":3,"end_column":' || (21 + d) || ',"message":"the environment here aligns nothing"}]' AS json, '[{"line":2,"character":' || (6 + d) || ',"message":"the environment here aligns nothing"}]' AS editor
FROM (SELECT p_partkey, length(p_size::VARCHAR) AS d, 'Rows ' || p_size || ' \begin{center} a & b \end{center}' AS src FROM part WHERE p_partkey % 7 = 0)""",
    "tex_names": f"SELECT p_partkey::BIGINT AS p_partkey, 'script-outside-math' AS code, 1::BIGINT AS n FROM part WHERE p_partkey % {len(NAMES) + len(LOUD)} >= {len(NAMES)}",
}
