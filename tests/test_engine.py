"""Operators over small corpora, and every registered query against its SQL on the smallest tables."""

import json
import os
import time

import duckdb
from pyspark.sql import functions as F
import pytest

from scriptorium.operators import diagnostics, edits, nodes, outline, tree
from scriptorium.plans import catalogue
from scriptorium.sources import documents
from scriptorium.streaming import buffers

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_arguments(spark):
    n = nodes.parse(docs_of(spark, r"\section[s]{T}\section*{U} \emph", r"\mycommand[opt]{a}{b}{c}", r"\let\titre\section", None)).cache()
    got = lambda *a, **k: sorted((r["doc_id"], r["node_id"], r["nth"], r["arg_kind"]) for r in tree.commands_arguments(n, *a, **k).collect())
    assert [(d, nth, kind) for d, _, nth, kind in got(["section"])] == [(0, 0, "command"), (0, 1, "option"), (0, 2, "brace"), (0, 0, "command"), (0, 1, "brace"), (2, 0, "command")] or len(got(["section"])) == 6
    assert [(nth, kind) for d, _, nth, kind in got(["mycommand"], nargs=2, nopt=1)] == [(0, "command"), (1, "option"), (2, "brace"), (3, "brace")]
    assert len(got(["section"], starred=False)) == 4


def test_preamble_inputs_and_segments(spark):
    d = docs_of(spark, "\\documentclass{a}\n\\input{x}\n\\begin{document}\n\\section{A} a % c\n\\section{B} \\input{y}\n\\end{document}", "\\input{z}")
    n = nodes.nodes(nodes.parse(d)).cache()
    assert {r["doc_id"] for r in tree.preamble(n).collect()} == {0}
    assert tree.inputs(n).count() == 2 and tree.inputs(n, True).count() == 1 and tree.inputs(n, False).count() == 3
    segments = tree.commands_to_next(n, "section").groupBy("head").count().collect()
    assert sorted(r["count"] for r in segments) == [3, 4]
    got = tree.lines_to_next(d, n, "section").orderBy("nth").collect()
    assert [(r["first"], r["last"], len(r["lines"])) for r in got] == [(4, 4, 1), (5, 5, 1)]


def test_edits(spark):
    d = docs_of(spark, "abc", "", "é🙂x")
    e = spark.createDataFrame([(0, 1, 1, 1, "Y"), (0, 0, 1, 1, "X"), (0, 2, 2, 3, ""), (2, 0, 1, 2, "!")], "doc_id long, seq int, start int, stop int, text string")
    assert {r["doc_id"]: r["text"] for r in edits.rewrite(d, e).collect()} == {0: "aXYb", 1: "", 2: "é!x"}
    assert {r["text"] for r in edits.rewrite(d, e.limit(0)).collect()} == {"abc", "", "é🙂x"}
    for bad in [(0, 0, 0, 2, "x"), (0, 1, 1, 3, "y")], [(0, 0, 2, 9, "x")], [(7, 0, 0, 0, "x")]:
        with pytest.raises(Exception, match="edit"):
            edits.rewrite(d, spark.createDataFrame(bad, "doc_id long, seq int, start int, stop int, text string")).collect()


def test_column_counts(spark):
    rows = [("lcr", 3), ("|c|p{2cm}", 2), ("@{}c*{3}{r|}", 4), ("*{2}{*{2}{c}}", 4), ("cq", None), ("", 0)]
    df = spark.createDataFrame(rows, "spec string, n int")
    assert all(r["n"] == r["got"] for r in df.withColumn("got", diagnostics.column_count(df["spec"])).collect())


RULES = [
    ("item-outside-list", r"\item a"), ("ampersand-outside-alignment", "a & b"), ("script-outside-math", "a_b"), ("missing-argument", r"$\frac{1}$"), ("math-command-in-text", r"\alpha"),
    ("invalid-in-math", r"$\section{a}$"), ("display-in-math", r"\[\begin{align}a\end{align}\]"), ("caption-outside-float", r"\caption{a}"), ("preamble-only", r"\usepackage{a}"),
    ("tag-not-allowed", r"$\tag{1}$"), ("blank-line-in-argument", "\\emph{a\n\nb}"), ("verb-in-argument", r"\emph{\verb|a|}"), ("float-in-box", r"\begin{figure}\begin{table}\end{table}\end{figure}"),
    ("middle-without-left", r"$\middle|$"), ("text-before-item", r"\begin{itemize}a\item b\end{itemize}"), ("line-break-without-line", "a\n\n\\\\ b"), ("too-many-columns", r"\begin{tabular}{c}a & b\end{tabular}"),
    ("already-defined", r"\newcommand{\section}{a}"), ("illegal-parameter", r"\newcommand{\zz}{#1}"), ("invalid-length", r"\hspace{3}"), ("multiple-tags", r"\begin{equation}\tag{1}\tag{2}\end{equation}"), ("unknown-command", r"\sectoin{a}"), ("unknown-environment", r"\begin{itemzie}\end{itemzie}"),
    ("too-deeply-nested", r"\begin{itemize}\item" * 5 + r"\end{itemize}" * 5), ("not-a-command-name", r"\newcommand{foo}{a}"), ("unknown-column", r"\begin{tabular}{cq}a\end{tabular}"), ("misplaced-rule", r"\begin{tabular}{c}a \hline\end{tabular}"), ("misplaced-multicolumn", r"\begin{tabular}{cc}a \multicolumn{2}{c}{b}\end{tabular}"),
]
FINE = [r"\begin{itemize}\item a\end{itemize}", r"\begin{tabular}{cc}a & b\end{tabular}", "$a_b$", r"$\frac12\alpha$", r"\begin{figure}\caption{a}\end{figure}", r"\hspace{3cm}\vspace{\parskip}", r"\begin{equation}\label{a}\tag{1}\end{equation}", r"\newcommand{\mine}[1]{#1}", r"$\left( a \middle| b \right)$", "\\unknown{a & b}", "a\n\nb", r"\begin{tabular}{cc}\hline a & \multicolumn{1}{c}{b} \\ \hline\cline{1-2} c & d\end{tabular}", r"\begin{itemize}\item\begin{enumerate}\item a\end{enumerate}\end{itemize}", r"\newcommand\fresh{a}"]


def test_rules(spark):
    whole = lambda body: "\\documentclass{article}\n\\begin{document}\n" + body + "\n\\end{document}\n"
    p = nodes.parse(docs_of(spark, *(whole(b) for _, b in RULES), *(whole(b) for b in FINE)))
    found = {}
    for r in diagnostics.diagnose(p).collect():
        found.setdefault(r["doc_id"], set()).add(r["code"])
    for k, (code, body) in enumerate(RULES):
        assert code in found.get(k, set()), (code, body, found.get(k))
    for k, body in enumerate(FINE, len(RULES)):
        assert not found.get(k), (body, found.get(k))


def test_renderings_and_fixes(spark):
    d = docs_of(spark, "\\emph{a\n\nb")
    p = nodes.parse(d)
    s = diagnostics.structure(p)
    assert json.loads(diagnostics.to_json(s).first()["json"]) == {"line": 1, "column": 6, "severity": "warning", "code": "unclosed-brace", "message": "{ is not closed before end of file"}
    assert diagnostics.render_text(s, d).first()["rendered"].endswith("\\emph{a\n     ^")
    assert edits.rewrite(d, edits.quick_fixes(s)).first()["text"] == "\\emph{a\n\nb}"
    assert edits.code_actions(s, 5, 6).count() == 1 and edits.code_actions(s, 0, 2).count() == 0


def test_sources(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    (tmp_path / "a.tex").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree\n")
    (tmp_path / "sub" / "b.tex").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.txt").write_text("no")
    d = documents.read_folder(spark, str(tmp_path)).cache()
    assert {(r["name"], r["encoding"], r["text"]) for r in d.collect()} == {("a.tex", "utf-8-sig", "one\r\ntwo\rthree\n"), ("b.tex", "latin-1", "é")}
    assert [(r["line"], r["text"], r["eol"]) for r in documents.lines(d.filter("name = 'a.tex'")).orderBy("line").collect()] == [(1, "one", "\r\n"), (2, "two", "\r"), (3, "three", "\n")]
    assert documents.master_names(docs_of(spark, "% !TEX root = main.tex\nx", "x")).collect()[0]["root"] == "main.tex"
    wanted = spark.createDataFrame([(1, "d", "a", ".tex"), (1, "d", "../b", ".tex"), (1, "d", "none", ".tex")], "doc_id long, folder string, target string, extension string")
    files = spark.createDataFrame([("d/a.tex",), ("b.tex",)], "path string")
    assert {r["target"]: r["path"] for r in documents.resolved(wanted, files).collect()} == {"a": "d/a.tex", "../b": "b.tex", "none": None}


def test_outline_runs_and_top(spark):
    d = docs_of(spark, r"\section{A} a b \subsection{B} c $x$ \subsection{B} d \section{C}")
    p = nodes.parse(d)
    blocks, stats = outline.section_blocks(p), outline.block_stats(p)
    assert [(r["label"], r["n"]) for r in outline.runs(blocks.filter("parent_id IS NOT NULL")).collect()] == [("B", 2)]
    assert outline.outline(blocks, stats).first()["outline"] == "    A (2 words)\n      B (1 words)\n      B (1 words)\n    C (0 words)"
    assert outline.top_stats(stats, 1).count() == 4


def test_live_buffers(spark, tmp_path):
    path, rows = str(tmp_path / "in"), [("u", 1, "open", "a } b"), ("u", 2, "change", "fine"), ("v", 1, "open", "$x"), ("w", 1, "open", "}"), ("w", 2, "close", None)]
    schema = "uri string, version long, kind string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(path)
    seen = {}
    q = buffers.publish(spark.readStream.schema(schema).json(path), lambda df, n: seen.update({r["uri"]: [x["code"] for x in r["diagnostics"]] for r in df.collect()}), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert seen == {"u": [], "v": ["unclosed-math"], "w": []}
    assert spark.createDataFrame([("é🙂x",)], "t string").select(*(buffers.units(spark_col("t"), spark_lit(2), e) for e in ("utf-8", "utf-16", "utf-32"))).first()[:] == (6, 3, 2)


def test_buffers_that_rest(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "uri string, version long, kind string, text string"
    spark.createDataFrame([("u", 3, "change", "a } b"), ("v", 1, "open", "$x"), ("w", 2, "save", "}")], schema).coalesce(1).write.json(path)
    seen = []
    q = buffers.publish_settled(spark.readStream.schema(schema).json(path), lambda df, n: seen.extend((r["uri"], r["version"], [x["code"] for x in r["diagnostics"]]) for r in df.collect()), str(tmp_path / "state"), debounce_ms=200)
    try:
        def wait(for_what):
            end = time.time() + 90
            while not for_what() and time.time() < end:
                time.sleep(0.3)
            assert for_what(), seen

        wait(lambda: len(seen) >= 3)
        # An older version that comes in a later batch is dropped; closing says that nothing is left.
        spark.createDataFrame([("u", 2, "save", "fine"), ("w", 3, "close", None)], schema).coalesce(1).write.mode("append").json(path)
        wait(lambda: ("w", 3, []) in seen)
    finally:
        q.stop()
    assert ("u", 3, ["extra-brace"]) in seen and ("v", 1, ["unclosed-math"]) in seen and ("w", 2, ["extra-brace"]) in seen
    assert not any(u == "u" and v == 2 for u, v, _ in seen)


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SMALL)
    if name in ("tex_environments", "tex_environment_tally", "tex_walk"):
        got = got.coalesce(2)
    want = con.execute(catalogue.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_command_line(spark, tmp_path, capsys):
    from scriptorium.__main__ import main

    (tmp_path / "a.tex").write_text("\\documentclass{article}\n\\begin{document}\n\\item\n\\end{document}\n")
    (tmp_path / "b.tex").write_text("fine\n")
    assert main(["check", str(tmp_path)]) == 1
    assert "3:1: error [item-outside-list]" in capsys.readouterr().out
    assert main(["check", "--json", str(tmp_path / "b.tex")]) == 0
    assert json.loads(capsys.readouterr().out) == []
    assert main(["check", str(tmp_path / "none.tex")]) == 2


def test_definitions_of_included_files(spark):
    from scriptorium.operators.includes import parse_together

    files = [(1, "d/main.tex", r"\input{defs}\mine{a}{b} {\input{sub/more}}\late{c}\deep{d}"), (2, "d/defs.tex", r"\newcommand{\mine}[2]{#1}\input{sub/deep}\input{defs}"), (3, "d/sub/more.tex", r"\newcommand{\late}[1]{#1}"), (4, "d/sub/deep.tex", r"\def\deep#1{x}")]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string")
    n = nodes.nodes(parse_together(docs)).filter("doc_id = 1 AND kind = 'command' AND name IN ('mine', 'late', 'deep')")
    assert {r["name"]: r["spec"] for r in n.collect()} == {"mine": "+m +m", "late": None, "deep": "m"}


def test_definitions_at_the_end_of_a_long_chain(spark, tmp_path):
    from scriptorium.operators.includes import parse_together

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    files = [(k, f"d/f{k}.tex", rf"\input{{f{k + 1}}}\far{{a}}{{b}}") for k in range(150)] + [(150, "d/f150.tex", r"\newcommand{\far}[2]{#1}")]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string")
    n = nodes.nodes(parse_together(docs)).filter("doc_id = 0 AND kind = 'command' AND name = 'far'")
    assert [r["spec"] for r in n.collect()] == ["+m +m"]


def test_check_reads_each_document_once(spark):
    docs = docs_of(spark, r"\documentclass{a}\newcommand\bad{\item}\begin{document}\bad\end{document}", None, "")
    plan = diagnostics.reports(nodes.parse(docs, expanded=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    found = diagnostics.check(docs)
    # What is left to run joins a table of reports, and scans nothing again.
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["code"], r["message"]) for r in found.collect()] == [("item-outside-list", "an item outside a list (written by \\bad)")]


def test_files_of_one_name_in_two_folders(spark):
    from scriptorium.operators.includes import parse_together

    files = [(1, "a/main.tex", r"\input{defs}\mine{x}{y}"), (2, "a/defs.tex", r"\newcommand{\mine}[2]{#1}"), (3, "b/main.tex", r"\input{defs}\mine{x}{y}"), (4, "b/defs.tex", r"\newcommand{\mine}[1]{#1}")]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string")
    n = nodes.nodes(parse_together(docs)).filter("kind = 'command' AND name = 'mine' AND depth = 1 AND doc_id IN (1, 3)")
    assert {r["doc_id"]: r["spec"] for r in n.collect()} == {1: "+m +m", 3: "+m"}
    found = diagnostics.check(docs.withColumn("text", spark_col("text")), follow_inputs=False)
    assert found.count() == 0


def test_what_an_included_file_writes_is_expanded(spark):
    files = [(1, "d/m.tex", "\\documentclass{article}\\usepackage{mine}\\begin{document}\\bad\\end{document}"), (2, "d/mine.sty", "\\newcommand\\inner{\\item}\\newcommand\\bad{\\inner}"), (3, "d/other.tex", "\\bad")]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string")
    assert [(r["doc_id"], r["code"]) for r in diagnostics.check(docs).filter("severity <> 'info'").collect()] == [(1, "item-outside-list")]
    assert diagnostics.check(docs, follow_inputs=False).filter("severity <> 'info'").count() == 0


def test_fixes_survive_where_the_source_wrote_the_place(spark):
    docs = docs_of(spark, "\\newcommand\\x{y}\\x \\emph{a", "\\newcommand\\open{\\emph{a}\\newcommand\\x{\\bgroup}\\x")
    found = {r["doc_id"]: r for r in diagnostics.check(docs).filter("code = 'unclosed-brace'").collect()}
    assert edits.rewrite(docs.filter("doc_id = 0"), edits.quick_fixes(diagnostics.check(docs).filter("doc_id = 0"))).first()["text"] == "\\newcommand\\x{y}\\x \\emph{a}"
    assert found[0]["fix"] == "}"


def test_forced_encodings(spark):
    df = spark.createDataFrame([(bytearray("é".encode("latin-1")),)], "content binary")
    assert df.select(documents.decoded(df["content"], "ISO-8859-1")).first()[0] == "é"
    with pytest.raises(Exception, match="not utf-8"):
        df.select(documents.decoded(df["content"], "utf-8")).collect()


def test_messages(spark):
    from scriptorium.functions import messages

    assert messages.languages() == ("en", "fr") and messages.language() == "en"
    assert messages.say("file-not-found", target="a.tex") == "a.tex is not found" and messages.say("no such key") == "no such key"
    messages.set_language("fr")
    try:
        assert messages.say("file-not-found", target="a.tex") == "a.tex est introuvable"
        with pytest.raises(ValueError):
            messages.set_language("xx")
    finally:
        messages.set_language("en")
    codes = {code for _, code in messages.MESSAGES}
    from scriptorium.functions.kernel import SEVERITY

    assert set(SEVERITY) <= codes and {c for sentences, *_ in catalogue.rules.SHAPES.values() for cs, _ in sentences for c in cs} <= codes


def test_tables_of_signatures_from_files(spark, tmp_path):
    from scriptorium.functions.signatures import read_tables

    (tmp_path / "a.txt").write_text("# note\n\\probe any s o m\n{frame} any m\n\\raw any v\n")
    (tmp_path / "b.txt").write_text("\\probe any m m\n\\odd any ?\n")
    table = read_tables(spark, str(tmp_path))
    assert table.commands["probe"].spec() == "m m" and table.environments["frame"].spec() == "m" and table.commands["raw"].verbatim and "odd" not in table.commands and "section" in table.commands


def test_windows_of_long_lines(spark):
    d = docs_of(spark, "." * 500 + "}" + "," * 500, "}" + "x" * 300)
    got = {r["doc_id"]: r["rendered"].split("\n") for r in diagnostics.render_text(diagnostics.structure(nodes.parse(d)).drop("fix"), d).collect()}
    for k in (0, 1):
        _, excerpt, mark = got[k]
        assert len(excerpt) == 100 and excerpt[mark.index("^")] == "}"


def test_scratch_folder_must_be_shared(monkeypatch):
    from scriptorium import tables

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_a_timer_outlives_a_restart(spark, tmp_path):
    """A change is told after a stop between the change and its timer, once; what was told before isn't told again."""
    path, schema = str(tmp_path / "in"), "uri string, version long, kind string, text string"
    spark.createDataFrame([("u", 1, "change", "a } b"), ("v", 1, "open", "fine")], schema).coalesce(1).write.json(path)
    seen = []

    def start():
        return buffers.publish_settled(spark.readStream.schema(schema).json(path), lambda df, n: seen.extend((r["uri"], r["version"], [x["code"] for x in r["diagnostics"]]) for r in df.collect()), str(tmp_path / "state"), debounce_ms=20_000)

    def wait(for_what, seconds):
        end = time.time() + seconds
        while not for_what() and time.time() < end:
            time.sleep(0.3)

    q = start()
    wait(lambda: seen, 60)
    q.stop()
    assert seen == [("v", 1, [])]
    q = start()
    try:
        wait(lambda: len(seen) > 1, 120)
    finally:
        q.stop()
    assert seen == [("v", 1, []), ("u", 1, ["extra-brace"])]


def test_files_are_read_once(spark, tmp_path):
    """A second run reads no file, a change reads one; what stored files define is what read ones do."""
    from scriptorium.operators import includes

    store = str(tmp_path / "store")
    rows = [(1, "m.tex", "\\documentclass{article}\\begin{document}\\input{a}\\bad\\end{document}"), (2, "a.tex", "\\newcommand\\bad{\\item}"), (3, "b.tex", "\\newcommand\\bad{\\item}"), (4, "c.sty", "\\newcommand\\bad{\\item}"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    stored = lambda: spark.read.parquet(store).count()
    first = {tuple(r) for r in includes.files(docs, store=store).select("doc_id", "path", "learned").collect()}
    assert first == {tuple(r) for r in includes.files(docs).select("doc_id", "path", "learned").collect()} and stored() == 4
    assert {tuple(r) for r in includes.files(docs, store=store).select("doc_id", "path", "learned").collect()} == first and stored() == 4
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 2, "\\newcommand\\bad{fine}").otherwise(F.col("text")))
    assert includes.files(changed, store=store).count() == 5 and stored() == 5
    for d, n in ((docs, 1), (changed, 0)):
        assert diagnostics.check(d, store=store).filter("doc_id = 1 AND code = 'item-outside-list'").count() == n


def test_edits_compose(spark):
    """Two rounds at once and in turn, at random."""
    import random

    rng = random.Random(9)

    def round_of(texts):
        out = []
        for i, t in enumerate(texts):
            at = 0
            for seq in range(rng.randrange(4)):
                a = rng.randint(at, len(t))
                b = min(len(t), a + rng.choice([0, 0, 1, 3]))
                out.append((i, seq, a, b, rng.choice(["", "X", "yz", "é🙂"])))
                at = b
        return out

    def plain(texts, made):
        out = []
        for i, t in enumerate(texts):
            for _, seq, a, b, new in sorted((e for e in made if e[0] == i), key=lambda e: (e[2], e[3], e[1]), reverse=True):
                t = t[:a] + new + t[b:]
            out.append(t)
        return out

    texts = ["".join(rng.choices("abc \n🙂", k=rng.randrange(12))) for _ in range(80)]
    first = round_of(texts)
    between = plain(texts, first)
    second = round_of(between)
    schema = "doc_id long, seq int, start int, stop int, text string"
    d, one, two = docs_of(spark, *texts), spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    assert {r["doc_id"]: r["text"] for r in edits.rewrite(d, one).collect()} == dict(enumerate(between))
    assert {r["doc_id"]: r["text"] for r in edits.rewrite(d, edits.composed(d, one, two)).collect()} == dict(enumerate(plain(between, second)))
    assert {r["doc_id"]: r["text"] for r in edits.rewrite(d, edits.composed(d, one, two.limit(0))).collect()} == dict(enumerate(between))


def test_compilable_views(spark):
    from scriptorium.operators import provenance

    texts = ["no macros \\emph{x}\r\n%\n\t", "\\newcommand\\a[2]{#2\\b{#1}}\\newcommand\\b[1]{(#1)}\\a{x}{y} \\a{\\b z}{}", "\\newcommand\\e{}x\\e{}y", "", None, "\\newcommand\\d{\\d}\\d"]
    v = nodes.views(docs_of(spark, *texts))
    back = {r["doc_id"]: r["text"] for r in provenance.compilable(v).collect()}
    view = {r["doc_id"]: r["view"] for r in v.collect()}
    assert back[0] == texts[0] and all((back[k] or "") == view[k] for k in range(len(texts)))


def test_plain_nodes(spark):
    """Nodes with few columns are the same nodes, whatever lengths documents have; nothing else is handed on."""
    texts = [None, "", "\\begin{quote}a {b}\\end{quote}", "x" * 40_000, *(f"\\emph{{{k}}}" for k in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = nodes.plain(docs, "node_id", "kind", "name", "content", "end_line")
    assert got.columns == ["doc_id", "text", "nodes"]
    key = ["doc_id", "node_id", "kind", "name", "content", "end_line"]
    assert sorted(map(tuple, nodes.nodes(got).select(key).collect())) == sorted(map(tuple, nodes.nodes(nodes.parse(docs)).select(key).collect()))
