"""The scan, expansion, prose and formula rules on strings, without a session."""

import pytest

from scriptorium.functions import kernel
from scriptorium.functions import expand, flatten, typeset
from scriptorium.functions.kernel import scan, walk
from scriptorium.functions.signatures import builtin, parse_spec, table_lines


def shape(n):
    if n.kind == "text":
        return n.content or "PAR"
    if n.kind == "command":
        return "\\" + n.name
    if n.kind in ("comment", "verbatim"):
        return (n.kind, n.content)
    return [n.delimiter or n.name, [shape(c) for c in n.children]]


TREES = [
    (r"\section{A title} text", ["\\section", ["{", ["A title"]], "text"]),
    (r"\frac12", ["\\frac", "1", "2"]),
    (r"$a$$b$", [["$", ["a"]], ["$", ["b"]]]),
    (r"$$a$$", [["$$", ["a"]]]),
    (r"\[ a \] \( b \)", [["\\[", ["a"]], ["\\(", ["b"]]]),
    ("a\n\n\nb", ["a", "PAR", "b"]),
    ("a % c\nb", ["a", ("comment", " c"), "b"]),
    (r"\cdot*", ["\\cdot", "*"]),
    (r"\foo*", ["\\foo*"]),
    (r"\foo[x]{y} [z]", ["\\foo", ["[", ["x"]], ["{", ["y"]], ["[", ["z"]]]),
    (r"text [z]", ["text [z]"]),
    (r"{\bf x", ["{", "\\bf", "x"]),
    (r"{\begin{a} x}", [["{", ["\\begin", ["{", ["a"]], "x"]]]),
    (r"{\end{a}}\begin{a}{x\end{a}", [["{", ["\\end", ["{", ["a"]]]], "\\begin", ["{", ["a"]], "{", "x", "\\end", ["{", ["a"]]]),
    ("$x\n\ny", ["$", "x", "PAR", "y"]),
    (r"\verb|a{%| b", [("verbatim", "a{%"), "b"]),
    (r"\verb{a{b}c} d", [("verbatim", "a{b}c"), "d"]),
    ("\\begin{verbatim}\r\n%{\r\n\\end{verbatim}x", [("verbatim", "\n%{\n"), "x"]),
    (r"\makeatletter\a@b\makeatother\a@b", ["\\makeatletter", "\\a@b", "\\makeatother", "\\a", "@b"]),
    (r"{\makeatletter}\a@b", [["{", ["\\makeatletter"]], "\\a", "@b"]),
    (r"\begin{document}x\end{document} never", [["document", ["x"]]]),
    (r"a^^5cb ^^25 c", ["a", "\\b", ("comment", " c")]),
    (r"\item[a] b", ["\\item", ["[", ["a"]], "b"]),
    ("", []),
    ("\r\n\r\n", ["PAR"]),
]


@pytest.mark.parametrize(("source", "expected"), TREES)
def test_trees(source, expected):
    assert [shape(c) for c in scan(source).root.children] == expected


DIAGNOSED = [
    (r"\documentclass{a}\begin{document}{x\end{document}", {"unclosed-brace"}),
    ("a } b", {"extra-brace"}),
    (r"\begin{center}\begin{quote}\end{center}", {"unclosed-environment"}),
    (r"\end{center}", {"end-without-begin"}),
    (r"\[ a $ b \]", {"dollar-in-math"}),
    (r"\[ a \( b \]", {"math-in-math"}),
    (r"a \) b", {"stray-math-close"}),
    (r"\documentclass{a}\begin{document}\begin{center}\begin{quote}\end{center}\end{quote}\end{document}", {"crossed-environments"}),
    (r"\begin{itemize}\item a\end{itemzie}", {"crossed-environment"}),
    (r"\verb|a", {"verb-across-lines"}),
    (r"\begin{verbatim}x", {"unclosed-verbatim"}),
    (r"\verb{a{b} c", {"verbatim-braces"}),
    ("$x\n\ny", {"unclosed-math"}),
    (r"\begin{quote} [ a \end{quote}", set()),
    (r"\sqrt[3 x", set()),
    (r"$x^a^b$", {"double-superscript"}),
    (r"$x_a_b$", {"double-subscript"}),
    (r"$x^2'$", {"double-superscript"}),
    (r"$x'^2$", set()),
    (r"$x^$", {"script-without-argument"}),
    (r"$x^_b$", {"script-without-argument"}),
    (r"$x^ 2$ $x^{}$ $x^\alpha_1$", set()),
    (r"\begin{align} x^ & y \end{align}", {"script-without-argument"}),
    (r"$a \over b \over c$", {"ambiguous-fraction"}),
    (r"$a \over b$ ${a \over b} \over c$", set()),
    (r"$x\limits_a$", {"limits-without-operator"}),
    (r"$\sum\limits_a$", set()),
    (r"$\left a + b \right)$", {"missing-delimiter"}),
    (r"$\left( x \right\} \left\langle y \right. \bigl[ z \bigr]$", set()),
]


@pytest.mark.parametrize(("source", "codes"), DIAGNOSED)
def test_events(source, codes):
    found = {e["code"] for e in flatten.parsed(1, source, None)["events"]}
    assert found - {"unclosed-bracket"} == codes


def test_severity_follows_context():
    severity = lambda t: [e.severity for e in scan(t).events]
    assert severity(r"\newcommand{\a}{\end{b}}") == ["info"]
    assert severity(r"\unknown{\end{b}}") == ["warning"]
    assert severity("\\documentclass{a}\n\\end{b}") == ["error"]
    assert severity(r"\end{b}") == ["warning"]  # a fragment


def test_positions_and_nested_sets():
    text = "a\r\n\\emph{b\n{c}}\rd"
    s = scan(text)
    rows = flatten.rows(s)[0]
    for r in rows[1:]:
        lines = text[: r["start"]].replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert (r["line"], r["col"]) == (len(lines), len(lines[-1]))
        parent = rows[r["parent_id"]]
        assert parent["node_id"] < r["node_id"] <= parent["last"] and parent["start"] <= r["start"] <= r["stop"] <= parent["stop"]
        if r["kind"] == "text" and r["content"]:
            assert text[r["start"] : r["stop"]].split() == r["content"].split()


def test_definitions_and_scopes():
    s = scan(r"\newcommand{\R}[2][d]{#1#2}\def\x#1{y}\let\z\R{\newcommand\loc{1}}\loc \R[a]{b}\newenvironment{e}[1]{s}{t}\begin{e}{x}\end{e}")
    names = [(d[1], d[2], d[3]) for d in s.definitions]
    assert names == [("newcommand", "R", 2), ("def", "x", 1), ("let", "z", None), ("newcommand", "loc", 0), ("newenvironment", "e", 1)]
    nodes = {n.name: n for n, *_ in walk(s.root) if n.kind == "command" and not n.bare}
    assert nodes["loc"].sig is None and len(nodes["R"].args) == 2
    assert not scan(r"\newcommand{\a}{\newcommand{\b}{c}}").definitions[1:]


def test_specifications():
    assert parse_spec("s o m")[0] and [k.kind for k in parse_spec("s o +m")[1]] == ["o", "m"]
    assert [k.kind for k in parse_spec("O{a{b}} t* r() d<> m")[1]] == ["o", "t", "r", "d", "m"]
    assert parse_spec("m s") is None and parse_spec("-") == (False, ())
    t = table_lines(["# comment", r"\mine any o m", "{box} math -", r"\mine any m"], builtin())
    assert t.commands["mine"].spec() == "m" and t.environments["box"].mode == "math" and "section" in t.commands
    n = scan(r"\mine{a}", t).root.children[0]
    assert len(n.args) == 1


@pytest.mark.parametrize(
    ("source", "view"),
    [
        (r"\newcommand{\R}{\mathbb{R}}$x\in\R$", r"\newcommand{\R}{\mathbb{R}}$x\in\mathbb{R}$"),
        (r"\newcommand{\p}[2][d]{<#1,#2>}\p{a}\p[b]c", r"\newcommand{\p}[2][d]{<#1,#2>}<d,a><b,c>"),
        (r"\def\a{\b}\def\b{x}\a", r"\def\a{\b}\def\b{x}x"),
        (r"\newcommand{\a}{\alpha}$\a x$", r"\newcommand{\a}{\alpha}$\alpha x$"),
        (r"\def\h{##}\h", r"\def\h{##}#"),
        ("no macros", "no macros"),
        ("", ""),
    ],
)
def test_expansion(source, view):
    got, pieces, _ = expand.expand(source)
    assert got == view
    assert "".join(got[p.start : p.stop] for p in pieces) == got
    for p in pieces:
        if p.expansion is None:
            assert source[p.source : p.source_stop] == got[p.start : p.stop]


def test_expansion_ends():
    got, _, _ = expand.expand(r"\def\a{\a\a}\a")
    assert len(got) < 16 * 20 + 100_000


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("word%\nnext, word % note\nnext", "wordnext, word next"),
        (r"\section{T} a~b", "T\n\na b"),
        (r"\'e t\'{e} \`a", "é té à"),
        (r"a\footnote{n} b", "a b\n\nn"),
        (r"x \ref{a}\label{b} y", "x ? y"),
        ("\\begin{itemize}\\item[k] one\n\\item two\\end{itemize}", "k one\ntwo"),
        (r"a\\b\par c", "a\nb\n\nc"),
        (r"\emph{a} $x^2$.", "a $x^2$."),
        (r"\documentclass{a}junk\begin{document}x\end{document}", "x"),
        (r"5\% \& \dots", "5% & …"),
    ],
)
def test_prose(source, text):
    s = scan(source)
    list(walk(s.root))
    got, marks = typeset.prose(s)
    assert got == text
    assert all(0 <= at < at + n <= len(got) for at, n, _ in marks)


def test_prose_without_formulas():
    s = scan("a $x$ b")
    list(walk(s.root))
    assert typeset.prose(s, "skip")[0] == "a b"


@pytest.mark.parametrize(
    ("source", "taken"),
    [
        (r"\iftrue a\else b\fi", [("a", True), ("b", False)]),
        (r"\newif\ifprof\proftrue\ifprof A\else B\fi", [("A", True), ("B", False)]),
        (r"\newif\ifprof\ifprof A\else B\fi", [("A", False), ("B", True)]),
        (r"\newif\ifprof{\proftrue}\ifprof A\fi", [("A", False)]),
        (r"\newif\ifa\ifx\x\y\atrue\fi\ifa A\fi", [(r"\x\y\atrue", None), ("A", None)]),
        (r"\ifnum 1<2 a\else b\fi", [("1<2 a", True), ("b", False)]),
        (r"\iffalse\iftrue a\fi\else b\fi", [("a", True), (r"\iftrue a\fi", False), ("b", True)]),
        (r"\newcommand{\x}{\iffalse} a", []),
    ],
)
def test_conditionals(source, taken):
    s = scan(source)
    assert [(source[b.start : b.stop].strip(), b.taken) for b in s.branches] == taken


def test_discarded_branches_are_silent():
    p = flatten.parsed(1, r"\iffalse } \newcommand{\a}{x} $x^a^b$ \input{f}\else y\fi \a", None)
    assert not p["events"] and not p["definitions"]
    assert [n["ctx"]["discarded"] for n in p["nodes"] if n["content"] == "y"] == [False]
    s = scan(r"a\iffalse b\else c\fi d")
    list(walk(s.root))
    assert typeset.prose(s)[0] == "acd"  # blanks after control words are none
    assert expand.expand(r"\newcommand{\R}{x}\iffalse\R\else\R\fi")[0] == r"\newcommand{\R}{x}\iffalse\R\else x\fi"


@pytest.mark.parametrize(("a", "b", "near"), [("secton", "section", True), ("abc", "acb", True), ("ab", "ba", False), ("abcde", "abxye", False), ("abcdef", "badcef", True), ("same", "same", False), ("itemize", "enumerate", False)])
def test_similar_names(a, b, near):
    assert kernel.similar(a, b) is near and kernel.similar(b, a) is near


@pytest.mark.parametrize(
    ("source", "view"),
    [
        (r"\newcommand{\a}[2][d]{#1-#2}\a{x} \a[y]{z}", "d-x y-z"),
        (r"\newenvironment{e}[1]{<#1|}{|>}\begin{e}{q}b\end{e}", "<q|b|>"),
        (r"\NewDocumentCommand\x{s O{d} m}{\IfBooleanTF{#1}{S}{N}#2#3}\x*{a}\x[o]{b}", "SdaNob"),
        (r"\NewDocumentEnvironment{f}{o m}{\IfNoValueTF{#1}{none}{#1}:#2}{!}\begin{f}{m}B\end{f}\begin{f}[k]{m}C\end{f}", "none:mB!k:mC!"),
        (r"\newcommand\a{x}\noexpand\a \a", r"\noexpand\a x"),
        (r"\newcommand\a{x}{\renewcommand\a{y}\a}\a", r"{\renewcommand\a{y}y}x"),
        (r"{\gdef\a{x}}\a", r"x"),
        (r"{\global\def\a{x}}\a", r"x"),
        (r"\newcommand\a{\a}\a", r"\a"),
        (r"\newcommand\a[1]{##1#1}\a{z}", "#1z"),
    ],
)
def test_views(source, view):
    from scriptorium.functions.expand import expand

    got, pieces, _ = expand(source)
    assert got.endswith(view), got
    assert "".join(got[p.start : p.stop] for p in pieces) == got


@pytest.mark.parametrize(
    ("source", "names"),
    [
        (r"\catcode`\@=11 \a@b", ["catcode", "a@b"]),
        (r"{\catcode`@11 \a@b}\a@b", ["catcode", "a@b", "a"]),
        (r"{\global\catcode`@=11}\a@b", ["global", "catcode", "a@b"]),
        (r"\catcode64=11\a@b", ["catcode", "a@b"]),
        (r"\catcode`\%12 a%\b", ["catcode", "b"]),
        (r"\catcode'100=11 \a@b \catcode" + '"40=12 ' + r"\a@b", ["catcode", "a@b", "catcode", "a"]),
        (r"\^^61b^^63 \^^M", ["abc", "\r"]),
    ],
)
def test_categories(source, names):
    s = scan(source)
    assert [n.name for n, *_ in walk(s.root) if n.kind == "command"] == names


def test_spans():
    spans = kernel.Spans([(5, 9), (1, 3), (2, 4), (9, 9)])
    assert [k in spans for k in range(11)] == [False, True, True, True, False, True, True, True, True, False, False] and not kernel.Spans([])


def test_an_expansion_scans_its_view_once(monkeypatch):
    """The last pass of an expansion is the scan of the view: nothing is scanned again."""
    texts = [r"a \emph{b}", r"\newcommand\m[1]{<#1>}\m{x} \begin{center}y\end{center}"]
    views = [expand.expand(t)[0] for t in texts]
    seen = []
    for module in (expand, flatten):
        monkeypatch.setattr(module, "scan", lambda text, *a, f=module.scan, **k: seen.append(text) or f(text, *a, **k))
    for t in texts:
        flatten.parsed(1, t, None, expanded=True)
    assert seen == [texts[0], texts[1], views[1]]


def test_plain_columns():
    """Columns without context are those of the whole rows."""
    for text in ("", "a b  c", "\\begin{itemize}\n\\item $x$ {a\n\n\\begin{quote}q\\end{quote}}\n\\end{itemize}\r\n\\emph*[o]{x", "\\begin{a}\\begin{b}x\\end{a}y\\end{b}%z"):
        want = flatten.rows(scan(text))[0]
        out = {c: [] for c in flatten.PLAIN_NODE}
        assert flatten.plain_rows(scan(text), out) == len(want)
        assert out == {c: [r["ctx"]["env"] if c == "env" else r[c] for r in want] for c in out}
