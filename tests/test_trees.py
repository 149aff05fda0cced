"""Interval joins, folds and rewriting against plain versions, on odd and on large documents."""

import random
import time

import pytest

from pyspark.sql import functions as F

from scriptorium.operators import diagnostics, folds, intervals, nodes, outline, provenance, related, tree
from scriptorium.sources import documents
from tests.test_engine import docs_of


def test_containing_intervals(spark):
    rng = random.Random(4)
    spans = [(rng.randrange(3), a, a + rng.choice([0, 1, 5, 300, 1 << 20])) for a in (rng.randrange(2000) for _ in range(300))]
    places = [(rng.randrange(4), rng.randrange(2500)) for _ in range(500)] + [(0, 1 << 20), (None, 5)]
    one = spark.createDataFrame([(*p, k) for k, p in enumerate(places)], "doc_id int, at long, place int")
    two = spark.createDataFrame([(*s, k) for k, s in enumerate(spans)], "doc_id int, start int, stop int, span int")
    got = sorted((r["place"], r["span"]) for r in intervals.containing(one, two).collect())
    assert got == sorted((i, j) for i, (d, p) in enumerate(places) for j, (e, a, b) in enumerate(spans) if d == e and a <= p < b)
    assert intervals.containing(one, two.limit(0)).count() == 0 and intervals.containing(one.limit(0), two).count() == 0
    last = {r["place"]: r["m"]["span"] if r["m"] else None for r in intervals.last_before(one, two.dropDuplicates(["doc_id", "start"]), at="at", marked="start", mark="m").filter("doc_id IS NOT NULL").collect()}
    for k, (d, p) in enumerate(places):
        own = [a for e, a, _ in spans if e == d and a <= p]
        assert d is None or (last[k] is None) == (not own) and (not own or spans[last[k]][1] == max(own))


def test_folds_are_linear(spark):
    small = docs_of(spark, r"a {b {c} d} $x$ \emph{y}", None, "{" * 30 + "x" + "}" * 30)
    p = nodes.parse(small)
    size = {(r["doc_id"], r["node_id"]): r["value"] for r in folds.folded(p, type="int", empty=F.lit(0), leaf=lambda n: F.lit(1), join=lambda v, rest: v + rest, group=lambda n, inner: inner + 1).collect()}
    for r in nodes.nodes(p).collect():
        assert size[r["doc_id"], r["node_id"]] == r["last"] - r["node_id"] + 1
    text = folds.folded(p, type="string", empty=F.lit(""), leaf=lambda n: n["content"], join=lambda v, rest: F.concat(v, rest), group=lambda n, inner: F.concat(F.lit("("), inner, F.lit(")")))
    assert text.filter("doc_id = 0 AND node_id = 0").first()["value"] == "(a(b(c)d)(x)(y))"
    many = nodes.parse_once(docs_of(spark, "\\section{a} x {y z} $a$ " * 12500))
    began = time.time()
    assert folds.content_hashes(many).agg(F.count_distinct("content_hash").alias("n")).first()["n"] == 8
    assert tree.enclosures(nodes.nodes(many), nodes.nodes(many).filter("kind = 'text'")).count() == 37500
    assert tree.commands_to_next(nodes.nodes(many), "section").count() == 62500
    blocks = outline.section_blocks(many)
    assert blocks.count() == 12500 and outline.rolled_up(blocks, outline.block_stats(many)).filter("key = 'words'").agg(F.sum("n").alias("n")).first()["n"] == 37500
    assert time.time() - began < 400  # all pairs would take hours


def test_rewriting_keeps_the_nodes(spark):
    texts = [r"\section [s]{T}  x%c", "a\n\n\n b \\\\ [2pt] ~ \\verb+x  y+ $$ a $$ \\( b\\) { }", "\\begin{tabular} {lc}\n a & b \\\\ \n\\hline\\end{tabular}\n\n", "", None, "% only\n", "é\t🙂 \\'e^^41", "{a", "a}b", "\\begin{x}", "\n\n", "\\emph\n{x}\r\n\r\ny\r\n\\begin{verbatim}\r\n a\r\n\\end{verbatim}"]
    p = nodes.parse(docs_of(spark, *texts))
    again = nodes.parse(tree.rewritten(p).select("doc_id", F.col("rewritten").alias("text")))
    shape = lambda q: {(r["doc_id"], r["node_id"]): r["content_hash"] for r in folds.content_hashes(q).collect()}
    before, after = shape(p), shape(again)
    assert before == after
    said = {r["doc_id"]: r["rewritten"] for r in tree.rewritten(p).collect()}
    assert said[0] == "\\section [s]{T} x%c" and said[1] == "a\n\nb \\\\ [2pt] ~ \\verb+x  y+ $$ a $$ \\( b\\) { }" and said[3] == said[4] == ""


def test_ends_of_checked_documents(spark):
    rng = random.Random(6)
    texts = ["\n".join(["x" * rng.randrange(9) for _ in range(rng.randrange(13))] + ["y" * rng.randrange(5) + "}" + "z" * rng.randrange(3)]) for _ in range(300)]
    d = docs_of(spark, *texts).repartition(5)
    ends = diagnostics.with_ends(diagnostics.check(d), d).collect()
    assert len(ends) == 300
    for r in ends:
        before = texts[r["doc_id"]][: r["stop"]]
        assert (r["end_line"], r["end_col"]) == (before.count("\n") + 1, len(before) - before.rfind("\n") - 1)


def test_paths(spark):
    want = {"a/b/../../c": "c", "../../c": "../../c", "p/q/../../../c": "../c", "a/././b": "a/b", "/a/../../b": "/b", "file:///x/../y": "file:///y", "hdfs://host/a/../b": "hdfs://host/b", "": "", ".": "", "a//b/": "a/b", "//a": "/a"}
    rows = spark.createDataFrame([(k,) for k in want], "path string")
    assert {r["path"]: r["n"] for r in rows.withColumn("n", documents.normalized(F.col("path"))).collect()} == want


def test_short_titles_and_sections_in_groups(spark):
    p = nodes.parse(docs_of(spark, r"\section{A}\begin{center}\section[s]{B}\end{center}\subsection*{C} \section", "none"))
    assert [(r["title"], r["short"]) for r in tree.sections(p).orderBy("node_id").collect()] == [("A", None), ("B", "s")]
    got = outline.section_blocks(p).orderBy("block_id").collect()
    assert [(r["label"], r["level"]) for r in got] == [("A", 2), ("B", 2), ("C", 3)] or len(got) == 4
    assert got[0]["stop"] == got[1]["start"] and got[2]["parent_id"] == got[1]["block_id"]


def test_children_by_place(spark):
    n = nodes.nodes(nodes.parse(docs_of(spark, "a {b {c} d} e", "x", None))).cache()
    said = lambda *path: {r["doc_id"]: r["content"] or r["kind"] for r in tree.child(n, *path).collect()}
    assert said(0) == {0: "a", 1: "x"} and said(-1) == {0: "e", 1: "x"} and said(1, -1) == {0: "d"} and said(1, 1, 0) == {0: "c"} and said(1, 7) == {} and said() == {0: "root", 1: "root", 2: "root"}


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_no_table_of_documents_is_broadcast(spark):
    """Reports, views, outlines and intervals of documents are many times the files that Spark estimates them by, so no estimate sends them through the driver."""
    docs = spark.createDataFrame([(k, "\\newcommand\\m[1]{<#1>}\\section{a}\\makeatletter\\m{b} \\iffalse c\\fi a & b", f"d/{k}.tex") for k in range(4)], "doc_id long, text string, path string")
    p, v = nodes.parse(docs), nodes.views(docs)
    spans = docs.select("doc_id", F.lit(0).alias("start"), F.lit(3).alias("stop"))
    assert _broadcasts(tree.enclosures(nodes.nodes(p), nodes.nodes(p))) == 0
    assert _broadcasts(provenance.source_spans(v, spans)) == 0
    assert _broadcasts(provenance.branch_regions(v, p)) == 0
    assert _broadcasts(provenance.category_regions(v, p)) == 0
    assert _broadcasts(provenance.node_sources(v)) == 0
    assert _broadcasts(outline.blocks(p)) == 0
    # The fixed table of known names is broadcast, and nothing else.
    assert _broadcasts(diagnostics.check(docs.drop("path"))) == 1
    assert _broadcasts(diagnostics.check(docs)) == 1


def test_overlapping_segments_are_told_in_one_pass(spark):
    """Each head with each sibling from it on, as a plain loop says, with and without comments; nothing is joined for it, and the query's nodes are shuffled once."""
    rng = random.Random(25)
    texts = ["".join(rng.choice(["\\chapter{a}", "\\chapter*{b}", "x ", "% c\n", "{\\chapter d ", "}", "\n\n", "$u$ "]) for _ in range(rng.randrange(30))) for _ in range(40)]
    n = nodes.nodes(nodes.parse(docs_of(spark, *texts, None))).cache()
    rows = n.orderBy("doc_id", "node_id").collect()
    for comments in (True, False):
        want = set()
        for h in rows:
            if h["kind"] == "command" and h["name"] in ("chapter", "chapter*") and not h["bare"]:
                after = [r for r in rows if (r["doc_id"], r["parent_id"]) == (h["doc_id"], h["parent_id"]) and r["sib"] >= h["sib"] and (comments or r["kind"] != "comment")]
                want |= {(h["doc_id"], h["node_id"], k, r["node_id"]) for k, r in enumerate(after)}
        got = tree.commands_to_next(n, "chapter", close_at_same_level=False, remove_comments=not comments)
        found = [(r["doc_id"], r["head"], r["nth"], r["node_id"]) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    from scriptorium.plans import structure

    plan = structure.tex_overlapping(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan[: plan.index("MapInArrow")].count("Exchange") == 1


@pytest.mark.parametrize("name", ["tex_rules_displays", "tex_rules_math"])
def test_rules_send_no_table_of_documents_through_the_driver(spark, name):
    """Also as the running plan is changed: whatever is small enough to be sent is not, but for the fixed table of known names."""
    from scriptorium.plans import rules

    df = rules.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and final.count("BroadcastHashJoin") <= 1


def test_a_name_is_looked_for_once(spark):
    """Many documents that include one file ask for it once; what is missing is told of each document and each place, from its own folder or none."""
    body = "\\documentclass{article}\\begin{document}\\includegraphics{a}\\includegraphics{b} \\includegraphics{b}\\end{document}"
    docs = spark.createDataFrame([(k, body, (f"d/{k}.tex", f"e/{k}.tex", f"{k}.tex", None)[k % 4]) for k in range(40)], "doc_id long, text string, path string")
    files = spark.createDataFrame([("d/a.png",), ("d/a.pdf",), ("e/b",), ("a.eps",)], "path string")
    folders = docs.select("doc_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    got = diagnostics.files_not_found(nodes.parse(docs), files, folders)
    at = {"a": [body.index("\\includegraphics{a}")], "b": [k for k in range(len(body)) if body.startswith("\\includegraphics{b}", k)]}
    want = [(k, f"{t} is not found", start) for k in range(40) for t in ("a" if k % 4 == 1 else "b") for start in at[t]]
    assert sorted((r["doc_id"], r["message"], r["start"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    tried = plan[plan.index("Generate posexplode") :]
    assert "HashAggregate(keys=[folder" in tried[: tried.index("Scan parquet")]


def test_blocks_of_intervals(spark):
    """Blocks are whole, few and disjoint for every interval, long or empty; only levels that fit in it are looked at."""
    cases = [(0, 0), (3, 2), (0, 1), (5, 6), (0, 8), (3, 17), (1, 2**31), (7, 2**39 + 5)]
    rows = spark.createDataFrame(cases, "a long, b long").select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("x"))
    for r in rows.collect():
        spans = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in r["x"])
        assert sum(hi - lo for lo, hi in spans) == max(0, r["b"] - r["a"])
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert not spans or (spans[0][0], spans[-1][1]) == (r["a"], r["b"])


def test_only_marks_that_reports_ask_for_leave_their_row(spark):
    docs = spark.createDataFrame([(1, "\\begin{center} a & b \\end{center} $x$ \\label{l}"), (2, "\\section{fine} $x$")], "doc_id long, text string")
    found = diagnostics.reports(nodes.parse(docs)).withColumn("asked", related.asked(F.col("found")))
    got = {r["doc_id"]: {m["key"] for m in r["marks"] or ()} for r in found.select("doc_id", related.asked_marks("asked", diagnostics.SHORT_ARGUMENTS).alias("marks")).collect()}
    assert got[1] <= {"environment"} and got[2] == set()
