"""What commands and environments take: argument specifications, the built-in table, and tables from files.

A specification is a list of kinds: `m` mandatory, `o` optional in brackets, `s` star, `t<c>` an optional character, `r<a><b>` and
`d<a><b>` delimited, `v` verbatim, `l` up to a brace, `g` optional in braces, `e{<c>...}` after a character each, `b` an environment's body,
`O{x}` and such with a default; `+` before a kind lets it hold paragraphs.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

BOUND = set("modrtlDRO")


@dataclass(frozen=True)
class Kind:
    kind: str
    long: bool = False
    marks: str = ""

    @property
    def mandatory(self) -> bool:
        return self.kind in "mrRvl"


@dataclass(frozen=True)
class Signature:
    """mode: text, math or any; kinds: the arguments without the star; verbatim: the content is not read."""

    mode: str
    kinds: tuple[Kind, ...] = ()
    starred: bool = False
    verbatim: bool = False

    def spec(self) -> str:
        return " ".join((["s"] if self.starred else []) + [("+" if k.long else "") + k.kind + k.marks for k in self.kinds])


_KIND = re.compile(r"\s*([+!>]*)(?:([mosvlbg])|(t)(.)|([rd])(.)(.)|([RD])(.)(.)|(O|G)|(e|E))", re.S)


def _braced(text: str, at: int) -> int:
    """The place after the braced group that begins at `at`, or `at` where none does."""
    if at >= len(text) or text[at] != "{":
        return at
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return i + 1
    return len(text)


def parse_spec(text: str) -> tuple[bool, tuple[Kind, ...]] | None:
    """(starred, kinds) of a specification; None where it can't be read."""
    starred, kinds, at = False, [], 0
    text = text.strip()
    if text in ("-", ""):
        return False, ()
    while at < len(text):
        m = _KIND.match(text, at)
        if not m:
            return None
        at, long = m.end(), "+" in m[1]
        if m[2] == "s":
            if kinds or starred:
                return None
            starred = True
        elif m[2]:
            kinds.append(Kind(m[2], long))
        elif m[3]:
            kinds.append(Kind("t", long, m[4]))
        elif m[5]:
            kinds.append(Kind(m[5], long, m[6] + m[7]))
        elif m[8]:
            kinds.append(Kind(m[8].lower(), long, m[9] + m[10]))
            at = _braced(text, at)
        elif m[11]:
            kinds.append(Kind("o" if m[11] == "O" else "g", long))
            at = _braced(text, at)
        else:
            end = _braced(text, at)
            kinds += [Kind("e", long, c) for c in text[at:end].strip("{} ")]
            at = _braced(text, end) if m[12] == "E" else end
        while at < len(text) and text[at].isspace():
            at += 1
    return starred, tuple(kinds)


def arity_spec(count: int, default: bool, long: bool) -> tuple[Kind, ...]:
    """The kinds of `count` parameters, the first optional where it has a default."""
    first = (Kind("o", long),) if default and count else ()
    return first + tuple(Kind("m", long) for _ in range(count - len(first)))


#: Public LaTeX: where a name comes from (the kernel, a standard class, a package), mode, specification, names. Fixed values.
_COMMANDS = """
kernel  | any  | o m o  | documentclass usepackage RequirePackage LoadClass
kernel  | any  | m      | input include includeonly label ref pageref bibliography bibliographystyle pagestyle thispagestyle
kernel  | any  | s m    | hspace vspace
kernel  | any  | o m    | cite linebreak pagebreak nolinebreak nopagebreak
kernel  | any  | m      | setcounter stepcounter value arabic roman Roman alph Alph mbox textrm ensuremath phantom hphantom vphantom typeout ProvidesPackage ProvidesClass
kernel  | any  | +m     | fbox hbox vbox AtBeginDocument AtEndDocument
kernel  | any  | o o o m +m | parbox
kernel  | any  | o o +m | makebox framebox
kernel  | any  | o m m  | rule
kernel  | any  | m o o +m | raisebox
kernel  | any  | m m    | addtocounter setlength addtolength PassOptionsToPackage PassOptionsToClass settowidth settoheight settodepth
kernel  | any  | m o    | newcounter
kernel  | any  | m      | newlength newsavebox stretch
kernel  | any  | -      | makeatletter makeatother ExplSyntaxOn ExplSyntaxOff relax par hfill vfill newpage clearpage cleardoublepage noindent centering raggedright raggedleft makeindex fill
kernel  | any  | -      | left right middle small footnotesize scriptsize tiny normalsize large Large LARGE huge Huge bfseries itshape ttfamily rmfamily sffamily mdseries upshape slshape scshape
kernel  | any  | s m o o +m | newcommand renewcommand providecommand DeclareRobustCommand
kernel  | any  | s m o o +m +m | newenvironment renewenvironment
kernel  | any  | +m m +m | NewDocumentCommand RenewDocumentCommand ProvideDocumentCommand DeclareDocumentCommand
kernel  | any  | m m +m +m | NewDocumentEnvironment RenewDocumentEnvironment ProvideDocumentEnvironment DeclareDocumentEnvironment
kernel  | any  | m +m +m | IfBooleanTF IfNoValueTF IfValueTF IfBlankTF
kernel  | any  | m +m   | IfBooleanT IfBooleanF IfNoValueT IfNoValueF IfValueT IfValueF
kernel  | any  | m l +m | def gdef edef xdef
kernel  | any  | m m    | let
kernel  | any  | m      | newif noalign
kernel  | text | m      | title date emph textbf textit texttt textsc textsf textsl textup textmd textnormal underline
kernel  | text | m      | ` ' ^ " ~ = . c v u H r k b d t
kernel  | text | o +m   | footnote footnotetext marginpar
kernel  | text | m      | author thanks
kernel  | text | -      | maketitle tableofcontents listoffigures listoftables hline
kernel  | text | o      | item
kernel  | text | s o m  | caption
kernel  | any  | s o    | \\
kernel  | any  | m m m  | multicolumn addcontentsline
kernel  | any  | m      | cline
kernel  | math | m m    | frac stackrel
kernel  | math | o m    | sqrt
kernel  | math | m      | mathbf mathrm mathcal mathit mathsf mathtt hat bar vec tilde dot ddot check breve acute grave overline widehat widetilde overbrace underbrace mathop mathbin mathrel
kernel  | math | -      | alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega
kernel  | math | -      | leq geq neq le ge ne approx equiv sim simeq cong propto in notin ni subset supset subseteq supseteq cup cap forall exists to mapsto times cdot pm mp div ast star circ bullet
kernel  | math | -      | infty partial nabla hbar ell Re Im wp aleph emptyset neg land lor wedge vee oplus otimes perp parallel mid langle rangle lfloor rfloor lceil rceil cdots ddots vdots limits nolimits
class   | text | s o m  | part section subsection subsubsection paragraph subparagraph
book    | text | s o m  | chapter
class   | text | -      | appendix
amsmath | any  | m      | eqref text intertext shortintertext numberwithin
amsmath | math | m m    | dfrac tfrac cfrac binom dbinom tbinom overset underset
amsmath | math | s m    | operatorname tag
amsmath | math | m      | boxed substack boldsymbol pmb
amsmath | math | -      | iint iiint notag implies impliedby iff dotsc dotsb dotsm dotsi
amssymb | math | m      | mathbb mathfrak
package | any  | s o m  | includegraphics
package | any  | m m    | href textcolor colorbox
package | any  | m      | url captionof
package | any  | m o m  | newcolumntype
"""
_ENVIRONMENTS = """
kernel  | any  | -      | document center flushleft flushright itemize enumerate sloppypar
kernel  | any  | -      | math displaymath equation eqnarray eqnarray*
kernel  | any  | o m    | tabular
kernel  | math | o m    | array
kernel  | any  | m o m  | tabular*
kernel  | any  | o o o m | minipage
kernel  | any  | m m    | list
class   | any  | -      | quote quotation verse abstract titlepage description
class   | any  | o      | figure table figure* table*
package | any  | o      | theorem lemma proof definition remark example
package | any  | m o m  | tabularx
package | any  | o m    | longtable
amsmath | math | -      | matrix pmatrix bmatrix vmatrix Bmatrix Vmatrix smallmatrix cases split
amsmath | math | o      | aligned gathered
amsmath | math | o m    | alignedat
amsmath | any  | -      | equation* align align* gather gather* multline multline* flalign flalign*
amsmath | any  | m      | alignat alignat* xalignat xalignat*
"""
_VERBATIM = "verb lstinline", "verbatim verbatim* Verbatim lstlisting minted comment"


def _regular() -> list[tuple[str, str]]:
    """Names of symbols that follow a rule: capital letters, operators, arrows, sized delimiters."""
    out = [("kernel", n) for n in "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()]
    out += [("kernel", n) for n in "sum prod coprod int oint bigcup bigcap bigoplus bigotimes bigvee bigwedge".split()]
    out += [("kernel", hyper) for f in ("sin", "cos", "tan", "cot") for hyper in (f, f"{f}h")] + [("kernel", f"arc{f}") for f in ("sin", "cos", "tan")]
    out += [("kernel", n) for n in "log ln lg exp max min sup inf lim limsup liminf det dim ker deg gcd arg Pr sec csc hom".split()]
    out += [("kernel", f"{long}{side}arrow") for long, sides in (("", ("left", "right", "leftright", "Left", "Right", "Leftright", "up", "down", "updown", "Up", "Down", "Updown")), ("long", ("left", "right", "leftright")), ("Long", ("left", "right", "leftright"))) for side in sides]
    return out


#: What is in arguments, where it isn't prose. Commands of which all arguments are names, paths, lists of keys, numbers or lengths; those of which
#: the first is and the rest are prose; those that set a formula; and those of which an option is prose.
NAMED = frozenset(
    "input include includeonly includegraphics graphicspath includesvg includepdf lstinputlisting verbatiminput label ref pageref eqref autoref cref Cref nameref vref hyperlink "
    "cite citep citet nocite parencite textcite autocite footcite bibliography bibliographystyle addbibresource pagestyle thispagestyle pagenumbering documentclass usepackage RequirePackage LoadClass "
    "PassOptionsToPackage PassOptionsToClass ProvidesPackage ProvidesClass hypersetup geometry setcounter addtocounter stepcounter refstepcounter newcounter value arabic roman Roman alph Alph numberwithin "
    "newlength newsavebox setlength addtolength hspace vspace rule cline cmidrule url path nolinkurl color definecolor colorlet selectlanguage usetikzlibrary index glossary gls typeout write".split()
)
FIRST_NAMED = frozenset("href textcolor colorbox hyperref foreignlanguage parbox raisebox addcontentsline multicolumn settowidth settoheight settodepth newtheorem captionof hypertarget".split())
FORMULAS = frozenset(("ensuremath",))
PROSE_OPTIONS = frozenset("part chapter section subsection subsubsection paragraph subparagraph caption item author title theorem lemma proof definition remark example sqrt".split())


def content_of(base: str, kind: Kind | None, nth: int) -> str:
    """What an argument holds: `name` (of any sort, not to be read), `formula` or `prose`; nth counts the mandatory ones before it."""
    if base in FORMULAS:
        return "formula"
    if kind is not None and not kind.mandatory:
        return "prose" if base in PROSE_OPTIONS else "name"
    return "name" if base in NAMED or (base in FIRST_NAMED and nth == 0) else "prose"


#: Sized delimiters take no argument in either mode.
_SIZES = [f"{size}{side}" for size in ("big", "Big", "bigg", "Bigg") for side in ("", "l", "r", "m")]
SIZED = frozenset(("left", "right", "middle", *_SIZES))

MATH_ENVIRONMENTS = frozenset("equation equation* align align* alignat alignat* xalignat xalignat* flalign flalign* gather gather* multline multline* eqnarray eqnarray* displaymath math".split())
DISPLAY = frozenset(MATH_ENVIRONMENTS - {"math"})
#: Environments that make a box within a formula.
INNER = frozenset("aligned alignedat gathered array matrix pmatrix bmatrix vmatrix Bmatrix Vmatrix smallmatrix cases".split())
TABLES = frozenset("tabular tabular* tabularx longtable array".split())
MATRICES = frozenset("matrix pmatrix bmatrix vmatrix Bmatrix Vmatrix smallmatrix".split())
ALIGNMENTS = frozenset("align align* alignat alignat* xalignat xalignat* flalign flalign* eqnarray eqnarray* cases aligned alignedat split".split()) | TABLES | MATRICES
#: Displays of which every row may have a number of its own.
ROWWISE = frozenset("align align* alignat alignat* xalignat xalignat* flalign flalign* gather gather* eqnarray eqnarray*".split())
LISTS = frozenset(("itemize", "enumerate", "description"))
FLOATS = frozenset(("figure", "table", "figure*", "table*"))


@dataclass(frozen=True)
class Table:
    commands: dict[str, Signature]
    environments: dict[str, Signature]
    origins: dict[str, str] = field(default_factory=dict)  # by \\name or {name}: kernel, class, book or a package


def table_lines(lines: list[str], base: Table | None = None) -> Table:
    """A table of lines `name mode spec` (`\\\\name` a command, `{name}` an environment), later lines winning, over a base."""
    commands, environments = (dict(base.commands), dict(base.environments)) if base else ({}, {})
    for line in lines:
        parts = line.split(None, 2)
        if len(parts) < 2 or line.lstrip().startswith("#"):
            continue
        name, mode, spec = parts[0], parts[1], parts[2].strip() if len(parts) == 3 else "-"
        if spec == "verbatim" or spec.split()[0] == "v":
            got = Signature(mode, (), False, True)
        elif (kinds := parse_spec(spec)) is not None:
            got = Signature(mode, kinds[1], kinds[0])
        else:
            continue
        if name.startswith("{"):
            environments[name[1:-1]] = got
        else:
            commands[name[1:]] = got
    return Table(commands, environments)


@functools.cache
def builtin() -> Table:
    lines, origins = [], {}
    for block, shape in ((_COMMANDS, "\\{}"), (_ENVIRONMENTS, "{{{}}}")):
        for row in block.strip().splitlines():
            origin, mode, spec, names = (x.strip() for x in row.split("|"))
            for n in names.split():
                lines.append(f"{shape.format(n)} {mode} {spec}")
                origins[shape.format(n)] = origin
    for origin, n in _regular():
        lines.append(f"\\{n} math -")
        origins[f"\\{n}"] = origin
    lines += [f"\\{n} any -" for n in _SIZES]
    lines += [f"\\{n} any v" for n in _VERBATIM[0].split()] + [f"{{{n}}} any verbatim" for n in _VERBATIM[1].split()]
    table = table_lines(lines)
    return Table(table.commands, table.environments, origins)


def read_tables(spark, path: str, base: Table | None = None) -> Table:
    """The table of files of such lines, over the built-in one; files by name, lines in order. A signature table fits the driver many times over."""
    from pyspark.sql import functions as F

    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("name"), "value").orderBy("name").collect()
    return table_lines([line for f in files for line in f["value"].splitlines()], base or builtin())
