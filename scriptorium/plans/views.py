"""Queries over views: sources of spans, regions of branches and categories, views written back; with the SQL that states their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import folds, nodes, outline, provenance
from scriptorium.plans.documents import PART, _big, _say, _t, part_documents
from scriptorium.tables import sorted_side, written


def tex_source_spans(spark, sf_dir):
    """What produced a stretch of a view through uses three deep: arguments alone, the whole use where it would be cut."""
    head = "\\newcommand\\a[2]{\\b{#2}-#1}\\newcommand\\b[1]{\\c{#1}}\\newcommand\\c[1]{(#1)}"
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say(head + "x\\a{@}{@}y", "p_size", "p_partkey").alias("text"))
    v = nodes.views_once(docs).select("doc_id", "text", "view", "pieces", "expansions")
    one, two, base = F.length(F.col("p_size").cast("string")), F.length(F.col("p_partkey").cast("string")), F.lit(len(head))
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", "p_partkey")
    # The view ends x(K)-Sy: K alone, K with what is about it, K to S, and all from x.
    shown = F.array(F.struct(F.lit("second").alias("what"), (base + 2).alias("start"), (base + 2 + two).alias("stop")), F.struct(F.lit("braced").alias("what"), (base + 1).alias("start"), (base + 3 + two).alias("stop")), F.struct(F.lit("both").alias("what"), (base + 2).alias("start"), (base + 4 + two + one).alias("stop")), F.struct(F.lit("from before").alias("what"), base.alias("start"), (base + 2 + two).alias("stop")))
    got = provenance.source_spans(v, part.select("doc_id", F.inline(shown))).join(sorted_side(docs), "doc_id")
    return got.select(_big("doc_id", "p_partkey"), "what", F.substr("text", F.col("source_start") + 1, F.col("source_stop") - F.col("source_start")).alias("source"))


def tex_node_sources(spark, sf_dir):
    """What produced each node of a view, and the macro that wrote it."""
    head = "\\newcommand\\m[1]{\\emph{#1!}}"
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say(head + "a \\m{@} b \\textbf{@}", "p_size", "p_partkey").alias("text"))
    got = provenance.node_sources(nodes.views_once(docs)).filter(F.col("start") >= len(head))
    return got.select(_big("doc_id", "p_partkey"), "kind", F.concat("name", "content").alias("said"), "source_text", "origin")


def tex_branch_regions(spark, sf_dir):
    """What of a view comes from which branch, with what macros wrote there."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\newcommand\\m{<@>}\\iftrue a\\m b\\else\\m c\\fi \\iffalse d\\fi", "p_size").alias("text"))
    v, p = nodes.views_once(docs), nodes.parse_once(docs)
    got = provenance.branch_regions(v, p).join(sorted_side(v.select("doc_id", "view")), "doc_id")
    return got.select(_big("doc_id", "p_partkey"), F.col("taken"), F.trim(F.substr("view", F.col("start") + 1, F.col("stop") - F.col("start"))).alias("shown"))


def tex_category_regions(spark, sf_dir):
    """What is shown under other categories than hold there, line by line."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\makeatletter\\newcommand\\m{a@"), F.col("p_size").cast("string"), F.lit("\nb}\\makeatother\\newcommand\\n{c}\nx\\m y\\n")).alias("text"))
    v, p = nodes.views_once(docs), nodes.parse_once(docs)
    got = provenance.category_regions(v, p).join(sorted_side(v.select("doc_id", "view")), "doc_id")
    return got.select(_big("doc_id", "p_partkey"), _big("line"), F.substr("view", F.col("start") + 1, F.col("stop") - F.col("start")).alias("shown"))


def tex_two_faces(spark, sf_dir):
    """A page whose text is the source or what its macros make of it."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\newcommand\\m[1]{<#1>}\\section{@}\n\\m{@} & \\m{\\m{x}}", "p_name", "p_size").alias("text"))
    # Headings alone are asked of the nodes, once, so their few rows come straight from the scan.
    p = nodes.plain(docs, "node_id", "kind", "base_name", "bare", "args", "start", "stop", "inner_start", "inner_stop", "line")
    got = outline.faces_page(nodes.views_once(docs), outline.section_blocks(p))
    return got.select(_big("doc_id", "p_partkey"), F.substring_index("page", "</style>", -1).alias("page"))


def tex_compilable(spark, sf_dir):
    """Documents with their macros written out, environments as groups, the rest as it was."""
    head = "\\newcommand\\a[1]{<\\b{#1}>}\\newcommand\\b[1]{#1#1}\\newenvironment{bx}[1]{[#1:}{]}\r\n"
    docs = part_documents(spark, sf_dir, _say("\\a{@} of  @ % \\a{x}", "p_size", "p_name"), head).withColumn("text", F.concat("text", F.lit("\n\\begin{bx}{k}in \\a{z}\\end{bx}.\t")))
    got = provenance.compilable(nodes.views_once(docs)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return got.filter("n > 0").select(_big("doc_id"), _big("n"), "line")


def tex_compilable_alike(spark, sf_dir):
    """What is written back reads as the view does; a document without macros comes back as it was."""
    docs = part_documents(spark, sf_dir, F.when(F.col("p_partkey") % 100 < PART, _say("\\sect{@} \\textbf{@} $\\vect{@}$", "p_name", "p_brand", "p_size")).otherwise(_say("{@} %  @", "p_name", "p_brand")), "\\newcommand\\sect[1]{\\section{#1}\\label{#1}}\\newcommand\\vect[1]{\\vec{x_{#1}}}\n")
    v = nodes.views_once(docs)
    back = written(provenance.compilable(v), "back")
    hashes = lambda d: folds.content_hashes(nodes.parse(d)).filter("node_id = 0").select("doc_id", "content_hash")
    both = hashes(back).join(sorted_side(hashes(v.select("doc_id", F.col("view").alias("text"))).withColumnRenamed("content_hash", "of_view")), "doc_id").join(sorted_side(back), "doc_id").join(sorted_side(docs.withColumnRenamed("text", "source")), "doc_id")
    return both.select(_big("doc_id"), (F.col("content_hash") == F.col("of_view")).alias("alike"), (F.col("text") == F.col("source")).alias("unchanged"))


QUERIES = {f.__name__: f for f in (tex_source_spans, tex_node_sources, tex_branch_regions, tex_category_regions, tex_two_faces, tex_compilable, tex_compilable_alike)}

_P = f"(p_partkey // {PART})::BIGINT AS doc_id"
_NTH = f"row_number() OVER (PARTITION BY p_partkey // {PART} ORDER BY p_partkey)::BIGINT"
ORACLE_SQL = {
    "tex_source_spans": r"SELECT p_partkey::BIGINT AS p_partkey, v.what, CASE v.what WHEN 'second' THEN p_partkey::VARCHAR WHEN 'from before' THEN 'x' || u ELSE u END AS source FROM (SELECT *, '\a{' || p_size || '}{' || p_partkey || '}' AS u FROM part), (VALUES ('second'), ('braced'), ('both'), ('from before')) AS v(what)",
    "tex_node_sources": r"""SELECT p_partkey::BIGINT AS p_partkey, v.kind, replace(replace(v.said, '@', p_size::VARCHAR), '~', p_partkey::VARCHAR) AS said, replace(replace(v.source_text, '@', p_size::VARCHAR), '~', p_partkey::VARCHAR) AS source_text, v.origin FROM part, (VALUES
  ('text', 'a', 'a', NULL), ('command', 'emph', '\m{@}', 'm'), ('brace', '{', '\m{@}', 'm'), ('text', '@!', '\m{@}', NULL), ('text', 'b', 'b', NULL), ('command', 'textbf', '\textbf', NULL), ('brace', '{', '{~}', NULL), ('text', '~', '~', NULL)
) AS v(kind, said, source_text, origin)""",
    "tex_branch_regions": r"SELECT p_partkey::BIGINT AS p_partkey, v.taken, replace(v.shown, '@', p_size::VARCHAR) AS shown FROM part, (VALUES (true, 'a<@> b'), (false, '\m c'), (false, 'd')) AS v(taken, shown)",
    "tex_category_regions": "SELECT p_partkey::BIGINT AS p_partkey, v.line::BIGINT AS line, v.shown || CASE WHEN v.line = 3 THEN p_size || chr(10) ELSE '' END AS shown FROM part, (VALUES (3, 'a@'), (4, 'b')) AS v(line, shown)",
    "tex_two_faces": r"""SELECT p_partkey::BIGINT AS p_partkey, '<input type=checkbox id=face><label for=face>expanded</label><nav><ul>' || chr(10) || '<li class="level2">' || p_name || '</li>' || chr(10) || '</ul></nav><main><pre>\newcommand\m[1]{&lt;#1&gt;}\section{' || p_name || '}' || chr(10) ||
  '<span class="source">\m{' || p_size || '}</span><span class="shown">&lt;' || p_size || '&gt;</span> &amp; <span class="source">\m{\m{x}}</span><span class="shown">&lt;&lt;x&gt;&gt;</span></pre></main>' AS page FROM part""",
    "tex_compilable": f"""SELECT {_P}, {_NTH} AS n, '<' || p_size || p_size || '> of  ' || p_name || ' % \\a{{x}}' AS line FROM part UNION ALL
SELECT doc_id, n + 1, '\\begingroup [k:in <zz>]\\endgroup{{}}.' || chr(9) FROM (SELECT {_P}, count(*)::BIGINT AS n FROM part GROUP BY 1)""",
    "tex_compilable_alike": f"SELECT DISTINCT {_P}, true AS alike, (p_partkey // {PART}) % 2 = 1 AS unchanged FROM part",
}
