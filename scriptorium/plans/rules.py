"""Registered queries on what rules report: sentences that break one rule or none, in surroundings of several kinds, one, two or three times.

A part's number selects a sentence and its surroundings, its size how often the sentence stands there; SQL says which codes each sentence earns and how often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import diagnostics

#: (what is reported, the sentence); @ is the part's number.
Sentence = tuple[tuple[str, ...], str]
#: Surroundings: ~ is where the sentences stand.
PROSE = (
    "Part @ is told of here. ~\n\nNothing else is wrong with it.\n",
    "\\section{Of part @}\nA first line.\n\n~\n\n\\subsection{More}\nA last line.\n",
    "It was said:\n\\begin{quote}\nso it is, ~ and so it stays.\n\\end{quote}\n",
    "\\begin{flushright}\n~\n\\end{flushright}\nA table with a note\\footnote{Of \\textbf{part} @.} is below.\n",
)
FORMULA = ("We know that $u + ~ + v$ holds for part @.\n", "From this it follows\n\\[ w = ~ + 1 \\]\nby part @.\n", "\\begin{equation*}\n~ - 2 \\label{part@}\n\\end{equation*}\nends it.\n", "\\begin{itemize}\n\\item first \\( ~ \\)\n\\item then part @\n\\end{itemize}\n")
ALONE = ("~",)

TEXT: list[Sentence] = [
    (("item-outside-list",), "\\item[bolt] weighs @ grams."), ((), "\\begin{description}\\item[bolt] weighs @ grams.\\end{description}"),
    (("ampersand-outside-alignment",), "Nuts & bolts cost \\emph{@}."), ((), "Nuts \\& bolts cost @."),
    (("script-outside-math",), "It covers m^2 of \\emph{@}."), ((), "It covers @ m$^2$ of floor."), ((), "See \\url{http://parts/no_@} and \\cite{maker_@}."),
    (("caption-outside-float",), "\\caption{A bolt of @ grams}"), ((), "\\begin{figure}A drawing.\\caption{A bolt of @ grams}\\end{figure}"),
    (("preamble-only",), "\\RequirePackage{bolts@}"), (("preamble-only",), "\\includeonly{bolts@}"),
    (("verb-in-argument",), "\\textsf{it prints \\verb+@+ here}"), ((), "It prints \\verb+@+ here."),
    (("blank-line-in-argument",), "\\textit{weight @\n\nand price}"), ((), "Told below\\footnote{weight @\n\nand price}."),
    (("float-in-box",), "\\fbox{\\begin{table}@\\end{table}}"), ((), "\\begin{table}\\fbox{@}\\end{table}"),
    (("text-before-item",), "\\begin{enumerate} Sorted by weight: \\item @ grams \\end{enumerate}"), ((), "\\begin{enumerate} % sorted by weight\n \\item @ grams \\end{enumerate}"),
    (("line-break-without-line",), "It weighs @ grams.\n\n\\newline Its price is low."), ((), "It weighs @ grams.\\newline Its price is low."),
    (("invalid-length",), "A gap \\hspace{@ feet} wide."), ((), "A gap \\hspace{@mm plus 1pt} wide."), ((), "A gap \\hspace{\\dimexpr @pt + 2pt\\relax} wide."),
    (("missing-argument",), "Price @: \\underline\n\n."), ((), "Price \\underline @."),
    (("too-deeply-nested",), "".join(f"\\begin{{{e}}}\\item " for e in ("itemize", "enumerate", "itemize", "enumerate", "itemize", "enumerate", "description")) + "@" + "".join(f"\\end{{{e}}}" for e in ("description", "enumerate", "itemize", "enumerate", "itemize", "enumerate", "itemize"))),
    ((), "".join(f"\\begin{{{e}}}\\item " for e in ("itemize", "enumerate", "itemize")) + "@" + "".join(f"\\end{{{e}}}" for e in ("itemize", "enumerate", "itemize"))),
    (("math-command-in-text",), "An angle \\theta of @ degrees."), ((), "An angle $\\theta$ of @ degrees."), (("math-command-in-text",), "\\begin{bmatrix} @ \\end{bmatrix}"),
    (("math-command-in-text",), "Part @ \\tag{p}."), ((), "\\begin{gather*} @ \\tag{p} \\end{gather*}"),
]
MATH: list[Sentence] = [
    (("double-subscript",), "k_{@}_m"), ((), "k_{@_m}"), (("double-superscript",), "r^{@}^t"), ((), "{r^{@}}^t"), (("script-without-argument",), "{@ h_}"), ((), "{@ h_{}}"),
    (("limits-without-operator",), "z\\limits^{@}"), ((), "\\prod\\limits^{@}"), (("ambiguous-fraction",), "{c \\over d \\over @}"), ((), "{c \\over {d \\over @}}"),
    (("missing-delimiter",), "\\Bigl m @ \\Bigr]"), ((), "\\Bigl[ @ \\Bigr]"), (("middle-without-left",), "@ \\middle/ m"), (("right-without-left",), "@ \\right]"), (("left-without-right",), "{\\left\\{ @}"), ((), "\\left\\{ @ \\middle/ m \\right]"),
    (("display-in-math",), "\\begin{multline} @ \\end{multline}"), ((), "\\begin{array}{c} @ \\end{array}"), (("invalid-in-math",), "\\footnote{@}"), ((), "\\mbox{@}"), (("missing-argument",), "{\\binom{@}}"), ((), "\\binom{@}{2}"), ((), "\\ensuremath{n_{@}}"),
]
DISPLAYS: list[Sentence] = [
    (("blank-line-in-math",), "\\begin{multline*}\nu + @\n\n= v\n\\end{multline*}\n"), ((), "\\begin{multline*}\nu + @\n%\n= v\n\\end{multline*}\n"),
    (("multiple-labels",), "\\begin{multline} @ \\label{p} + 1 \\label{q} \\end{multline}\n"), ((), "\\begin{gather} @ \\label{p} \\\\ 1 \\label{q} \\end{gather}\n"),
    (("multiple-tags",), "\\begin{equation*} @ \\tag{p} + 1 \\tag{q} \\end{equation*}\n"), ((), "\\begin{gather} @ \\tag{p} \\\\ 1 \\tag{q} \\end{gather}\n"),
    (("left-across-cells",), "\\[ \\begin{aligned} \\left[ @ & = 2 \\right] \\end{aligned} \\]\n"), ((), "\\[ \\begin{aligned} \\left[ @ \\right] & = 2 \\end{aligned} \\]\n"), (("tag-not-allowed",), "\\[ \\begin{gathered} @ \\tag{p} \\end{gathered} \\]\n"),
]
TABLE: list[Sentence] = [
    (("too-many-columns",), "\\begin{tabular}{r||l} weight & @ & grams \\\\ price & low \\end{tabular}"), ((), "\\begin{tabular}{r||l|r} weight & @ & grams \\\\ price & low \\end{tabular}"),
    (("too-many-columns",), "\\begin{longtable}{*{2}{r!{.}}} @ & 2 & 3 \\\\ \\end{longtable}"), ((), "\\begin{tabularx}{5cm}{lX} weight & @ \\end{tabularx}"), (("too-many-columns",), "\\begin{tabular}{*{2}{r}} \\multicolumn{2}{l}{weight} & @ \\end{tabular}"), ((), "\\begin{tabular}{*{2}{r}} \\multicolumn{2}{l}{weight @} \\\\ 1 & 2 \\end{tabular}"),
    (("misplaced-rule",), "\\begin{tabular}{l} weight @ \\cline{1-1} \\\\ price \\end{tabular}"), ((), "\\begin{tabular}{l} \\cline{1-1} weight @ \\\\ \\cline{1-1} price \\\\ \\hline \\end{tabular}"),
    (("misplaced-multicolumn",), "\\begin{tabular}{rll} weight \\multicolumn{2}{r}{@} \\end{tabular}"), ((), "\\begin{tabular}{rll} weight & \\multicolumn{2}{r}{@} \\end{tabular}"),
    (("unknown-column",), "\\begin{tabular}{l|z} weight & @ \\end{tabular}"), ((), "\\begin{tabular}{l|p{2cm}} weight & @ \\end{tabular}"), (("invalid-length",), "\\begin{tabular}{l} weight \\\\[@] price \\end{tabular}"), ((), "\\begin{tabular}{l} weight \\\\[@pt] price \\end{tabular}"),
]
DEFINITIONS: list[Sentence] = [
    (("illegal-parameter",), "\\newcommand{\\bolt}[2][m]{#1 by #3} @"), ((), "\\newcommand{\\bolt}[2][m]{#1 by #2} @"), (("illegal-parameter",), "\\gdef\\bolt#1#2{#1#3} @"), ((), "\\gdef\\bolt#1#2{#2#1} @"),
    (("illegal-parameter",), "\\newenvironment{bolts}[2]{#1 #2}{until #2} @"), ((), "\\newenvironment{bolts}[2]{#1 #2}{until then} @"), (("illegal-parameter",), "\\DeclareDocumentCommand\\bolt{O{1} m}{#3} @"), ((), "\\DeclareDocumentCommand\\bolt{O{1} m}{#2} @"),
    (("already-defined",), "\\newcommand{\\sqrt}{@}"), ((), "\\renewcommand{\\sqrt}{@}"), (("already-defined",), "\\newenvironment{quote}{@}{}"), ((), "\\newenvironment{bolts}{@}{}"), (("already-defined",), "\\newcommand\\bolt{@}\\newcommand\\bolt{again}"), (("not-a-command-name",), "\\renewcommand{bolt}{@}"),
]
STRUCTURE: list[Sentence] = [
    (("unclosed-brace",), "{\\bfseries Part @ is bold"), ((), "{\\bfseries Part @ is bold}"), (("extra-brace",), "Part @ is done}."), (("unclosed-math",), "It costs $u + @\n\nat most."), ((), "It costs \\$@ at most."), (("unclosed-environment",), "\\begin{flushleft} Part @"),
    (("crossed-environments",), "\\begin{center}\\begin{verse} Part @ \\end{center}\\end{verse}"), (("crossed-environment",), "\\begin{flushleft} Part @ \\end{flushlfet}"), (("dollar-in-math",), "Here \\[ u $ @ \\]"), (("stray-math-close",), "Part @ \\) ends."), (("verb-across-lines",), "It prints \\verb+@"),
    (("end-without-begin",), "Part @ \\end{verse} ends."), ((), "\\iffalse \\begin{verse} @ \\fi"), (("missing-argument", "unclosed-bracket"), "\\subsection[Part @\n\nends"), (("text-in-preamble",), "!Bolts of part @."), ((), "!\\title{Bolts of part @}"),
]


def texts(sentences: list[Sentence], around: tuple[str, ...], times: int) -> list[str]:
    """A document for each sentence and surroundings; one that begins with ! stands in the preamble."""
    out = []
    for _, said in sentences:
        for place in around:
            head, body = (said[1:] + "\n", "Nothing here.") if said.startswith("!") else ("", place.replace("~", " ".join([said] * times)))
            out.append(f"\\documentclass{{article}}\n\\usepackage{{amsmath}}\n{head}\\begin{{document}}\n{body}\n\\end{{document}}\n")
    return out


def shaped(spark: SparkSession, sf_dir: str, sentences: list[Sentence], around: tuple[str, ...], most: int) -> DataFrame:
    """(doc_id, text): the sentence and the surroundings that each part's number selects, as often as its size says."""
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), "p_size").repartition(tasks, "doc_id")
    kinds = len(sentences) * len(around)
    chosen = F.element_at(F.array(*(F.array(*map(F.lit, texts(sentences, around, k + 1))) for k in range(most))), (F.col("p_size") % most + 1).cast("int"))
    return part.select("doc_id", F.replace(F.element_at(chosen, (F.col("doc_id") % kinds + 1).cast("int")), F.lit("@"), F.col("doc_id").cast("string")).alias("text"))


def rule_query(name: str, sentences: list[Sentence], around: tuple[str, ...], most: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = diagnostics.check(shaped(spark, sf_dir, sentences, around, most)).filter("severity <> 'info'")
        return found.groupBy(F.col("doc_id").cast("long").alias("p_partkey"), "code").agg(F.count("*").alias("n"))

    query.__name__ = query.__qualname__ = name
    query.__doc__ = f"What is reported of {len(sentences)} sentences in {len(around)} kinds of surroundings, up to {most} times each."
    return query


def rule_sql(sentences: list[Sentence], around: tuple[str, ...], most: int) -> str:
    rows = ", ".join(f"({k * len(around) + j}, '{code}')" for k, (codes, _) in enumerate(sentences) for j in range(len(around)) for code in codes)
    return f"SELECT p_partkey::BIGINT AS p_partkey, code, (p_size % {most} + 1)::BIGINT AS n FROM part JOIN (VALUES {rows}) AS v(k, code) ON p_partkey % {len(sentences) * len(around)} = v.k"


#: Sentences, their surroundings, and how often one may stand there.
SHAPES = {"tex_rules_text": (TEXT, PROSE, 3), "tex_rules_math": (MATH, FORMULA, 3), "tex_rules_displays": (DISPLAYS, ALONE, 3), "tex_rules_tables": (TABLE, PROSE, 3), "tex_rules_definitions": (DEFINITIONS, PROSE, 1), "tex_rules_structure": (STRUCTURE, PROSE[:2], 1)}
QUERIES = {name: rule_query(name, *shape) for name, shape in SHAPES.items()}
ORACLE_SQL = {name: rule_sql(*shape) for name, shape in SHAPES.items()}
