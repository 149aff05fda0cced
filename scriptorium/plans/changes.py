"""Queries over edits, messages and files that are read once; with the SQL that states their answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.functions import messages
from scriptorium.operators import diagnostics, edits, includes, nodes, tree
from scriptorium.plans.documents import _big, _say, _t
from scriptorium.tables import shared_dir, sorted_side, written


def tex_edit_parts(spark, sf_dir):
    """Edits before, after, inside and at both delimiters of groups, made together."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("a \\emph{@} \\begin{quote}@\\end{quote} $x$ b", "p_size", "p_name").alias("text"))
    n = nodes.nodes(nodes.parse_once(docs))
    quote, brace, math = n.filter(tree.is_env("quote")), n.filter("kind = 'brace'"), n.filter(tree.is_env("$"))
    made = [edits.before(brace, "<"), edits.inside(brace, F.concat(F.lit("n"), F.col("line").cast("string"))), edits.after(brace, ">"), edits.opening(quote, "\\begin{center}"), edits.closing(quote, "\\end{center}"), edits.of(math, "y")]
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    return edits.rewrite(docs, every).select(_big("doc_id", "p_partkey"), "text")


def _rounds(spark, sf_dir):
    """Documents, a first round of edits, and a second one, of what the first made."""
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _say("\\emph{@} and {@} end", "p_size", "p_name").alias("text"))
    own = nodes.nodes(nodes.parse_once(docs))
    first = edits.of(own.filter(tree.is_command("emph")), "\\textbf").unionByName(edits.after(own.filter("kind = 'brace'"), "\\label{l}"))
    between = written(edits.rewrite(docs, first), "between")
    n = nodes.nodes(nodes.parse_once(between))
    second = edits.of(n.filter(tree.is_command("label")), "").unionByName(edits.before(n.filter(tree.is_command("textbf")), "[")).unionByName(edits.inside(n.filter("kind = 'brace' AND sib = 1"), "new")).unionByName(edits.after(n.filter("kind = 'text' AND sib > 2 AND content LIKE '%end'"), "]"))
    return docs, first, between, second


def tex_edits_composed(spark, sf_dir):
    """Two rounds of edits at once do what one after the other does."""
    docs, first, between, second = _rounds(spark, sf_dir)
    at_once = edits.rewrite(docs, edits.composed(docs, first, second))
    in_turn = edits.rewrite(between, second).withColumnRenamed("text", "in_turn")
    return at_once.join(sorted_side(in_turn), "doc_id").select(_big("doc_id", "p_partkey"), "text", (F.col("text") == F.col("in_turn")).alias("same"))


def tex_places_carried(spark, sf_dir):
    """Where places stand after edits."""
    docs, first, between, _ = _rounds(spark, sf_dir)
    places = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.instr("text", "and") - 1, F.length("text"))).alias("at"))
    moved = edits.carried(places, first).join(sorted_side(between), "doc_id")
    return moved.select(_big("doc_id", "p_partkey"), _big("at"), F.substr("text", F.col("moved") + 1, F.lit(3)).alias("there"))


def tex_told(spark, sf_dir):
    """Whole messages in two languages, with their fields."""
    shapes = F.array(*map(F.lit, ("{@", "\\begin{center} @", "\\begin{tabular}{l} a & b & @ \\end{tabular}", "@ \\end{verse}", "\\newcommand\\m[1]{#3}", "}", "\\newcommand\\w{\\item}\\w @", "$x^2^@$")))
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("\\documentclass{article}\\begin{document}\n"), F.replace(F.element_at(shapes, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("@"), F.col("p_size").cast("string")), F.lit("\n\\end{document}\n")).alias("text"))
    found = diagnostics.check(docs).filter("severity <> 'info'")
    both = messages.told(messages.told(found, "fr").withColumnRenamed("told", "fr"), "en")
    return both.select(_big("doc_id", "p_partkey"), "code", "fr", F.col("told").alias("en"))


def tex_replayed(spark, sf_dir):
    """Files read in three runs over a corpus with one store: all of a part of it, what is new or changed, and none; and what a file defines in the end."""
    part = _t(spark, sf_dir, "part")
    text = F.concat(F.lit("\\newcommand\\m{"), F.col("p_brand"), F.lit("}"))
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.format_string("f%d.tex", "p_partkey").alias("path"), text.alias("text"), "p_size")
    later = docs.withColumn("text", F.when(F.col("p_size") % 10 == 0, F.concat("text", F.lit("\\newcommand\\n{}"), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    store = f"{shared_dir(spark)}/learned-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    counts = []
    for run in (docs.filter("p_size % 2 = 0"), later, later):
        got = includes.files(run.drop("p_size"), store=store)
        kept = spark.read.schema(includes.STORED).parquet(store)
        counts.append((kept.count(), got))
    told = counts[2][1].select(_big("doc_id", "p_partkey"), F.get_json_object("learned", "$[0][1]").alias("name"), F.size(F.from_json("learned", "array<string>")).cast("long").alias("learned"))
    return told.crossJoin(F.broadcast(spark.createDataFrame([(counts[0][0], counts[1][0] - counts[0][0], counts[2][0] - counts[1][0])], "first long, second long, third long")))


QUERIES = {f.__name__: f for f in (tex_edit_parts, tex_edits_composed, tex_places_carried, tex_told, tex_replayed)}

ORACLE_SQL = {
    "tex_edit_parts": r"SELECT p_partkey::BIGINT AS p_partkey, 'a \emph<{n1}> \begin{center}' || p_name || '\end{center} y b' AS text FROM part",
    "tex_edits_composed": r"SELECT p_partkey::BIGINT AS p_partkey, '[\textbf{new}{l} and {' || p_name || '}{l} end]' AS text, true AS same FROM part",
    "tex_places_carried": r"SELECT p_partkey::BIGINT AS p_partkey, (CASE v.k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 8 + length(p_size::VARCHAR) ELSE 18 + length(p_size::VARCHAR) + length(p_name) END)::BIGINT AS at, CASE v.k WHEN 2 THEN 'and' WHEN 3 THEN '' ELSE substr('{' || p_size || '}\', 1, 3) END AS there FROM part, (VALUES (0), (1), (2), (3)) AS v(k)",
    "tex_told": r"""SELECT p_partkey::BIGINT AS p_partkey, v.code, replace(v.fr, '@', p_size::VARCHAR) AS fr, replace(v.en, '@', p_size::VARCHAR) AS en FROM part JOIN (VALUES
  (0, 'unclosed-brace', '{ n''est pas fermé avant end of file', '{ is not closed before end of file'), (1, 'unclosed-environment', 'l''environnement center n''est pas fermé avant \end{document}', 'center is not closed before \end{document}'),
  (2, 'too-many-columns', '3 cellules dans une ligne de 1 colonnes', '3 cells in a row of 1 columns'), (3, 'end-without-begin', 'aucun environnement verse n''est ouvert', 'no verse is open'), (4, 'illegal-parameter', 'paramètre 3 sur 1', 'parameter 3 of 1'),
  (5, 'extra-brace', 'une accolade ne ferme rien', 'a brace closes nothing'), (6, 'item-outside-list', 'un élément hors d''une liste (écrit par \w)', 'an item outside a list (written by \w)'), (7, 'double-superscript', 'un second exposant', 'a second superscript')
) AS v(k, code, fr, en) ON p_partkey % 8 = v.k""",
    "tex_replayed": r"""WITH d AS (SELECT p_partkey, p_size, p_brand AS one, CASE WHEN p_size % 10 = 0 THEN p_brand || '|' || p_partkey ELSE p_brand END AS two FROM part),
c AS (SELECT (SELECT count(DISTINCT one) FROM d WHERE p_size % 2 = 0)::BIGINT AS first, (SELECT count(DISTINCT two) FROM d WHERE two NOT IN (SELECT one FROM d WHERE p_size % 2 = 0))::BIGINT AS second)
SELECT p_partkey::BIGINT AS p_partkey, 'm' AS name, (CASE WHEN p_size % 10 = 0 THEN 4 ELSE 2 END)::BIGINT AS learned, c.first, c.second, 0::BIGINT AS third FROM d, c""",
}
