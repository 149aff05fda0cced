"""What a document reads like: prose of its nodes, with the node that each stretch of it comes from."""

from __future__ import annotations

import re
import unicodedata

from scriptorium.functions.kernel import DEFINING, Node, Scanned, Spans

#: TeX accents as combining characters, and words for symbols.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328", "b": "\u0331", "d": "\u0323", "t": "\u0361"}
#: Letters without their dot.
DOTLESS = {"i": "\u0131", "j": "\u0237"}
WORDS = {"dots": "…", "ldots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "oe": "œ", "ae": "æ", "OE": "Œ", "AE": "Æ", "ss": "ß", "o": "ø", "O": "Ø", "%": "%", "$": "$", "&": "&", "#": "#", "_": "_", "{": "{", "}": "}", " ": " ", ",": " ", ";": " ", "quad": " ", "qquad": " ", "textbackslash": "\\", "og": "« ", "fg": " »", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "textellipsis": "…", "textendash": "–", "textemdash": "—", "textbar": "|", "textless": "<", "textgreater": ">", "textasciitilde": "~", "textasciicircum": "^", "textquoteleft": "‘", "textquoteright": "’", "textquotedblleft": "“", "textquotedblright": "”", "guillemotleft": "«", "guillemotright": "»", "dag": "†", "ddag": "‡", "textbullet": "•", "textdegree": "°", "texteuro": "€", "euro": "€", "BibTeX": "BibTeX", "LaTeXe": "LaTeX2ε"}
SECTIONS = frozenset("part chapter section subsection subsubsection paragraph subparagraph".split())
SILENT = frozenset("label documentclass usepackage RequirePackage bibliographystyle pagestyle thispagestyle includegraphics input include setcounter addtocounter setlength hspace vspace newcounter numberwithin multicolumn cline".split()) | DEFINING
_INK = re.compile(r"\s*")
REFERENCES = frozenset("ref eqref pageref cite".split())


class Prose:
    def __init__(self, math: str) -> None:
        self.parts: list[str] = []
        self.marks: list[tuple[int, int, int]] = []  # place, length, node
        self.size, self.blank, self.math = 0, "", math
        self.notes: list[tuple[Node, Node]] = []

    def space(self, b: str) -> None:
        """The strongest blank that waits wins; none stands at the head."""
        if len(b) > len(self.blank) or (b == "\n" and self.blank == " "):
            self.blank = b

    def ink(self, s: str, node: Node) -> None:
        if not s:
            return
        if self.size and self.blank:
            self.parts.append(self.blank)
            self.size += len(self.blank)
        self.blank = ""
        self.marks.append((self.size, len(s), node.index))
        self.parts.append(s)
        self.size += len(s)


def prose(s: Scanned, math: str = "source") -> tuple[str, list[tuple[int, int, int]]]:
    """(text, marks) of a scanned document whose nodes are numbered (walk()); math: `source` keeps formulas as written, `skip` drops them."""
    out = Prose(math)

    def formula(n: Node) -> None:
        if math == "source":
            out.ink(s.text[n.start : n.end], n)
        else:
            out.space(" ")

    discarded = Spans((b.start, b.stop) for b in s.branches if b.taken is False)

    def visit(nodes: list[Node]) -> None:
        used: set[int] = set()
        if discarded:
            nodes = [n for n in nodes if n.role is None and n.start not in discarded]
        previous = None
        for k, n in enumerate(nodes):
            if id(n) in used:
                previous = max(previous or 0, n.end)
                continue
            if previous is not None and n.start > previous and s.text[previous : n.start].strip() == "" and s.text[previous : n.start]:
                out.space(" ")
            previous = max(previous or 0, n.end)
            if n.kind == "text":
                if n.is_par():
                    out.space("\n\n")
                else:
                    t = n.content.replace("~", " ")
                    if t[:1] == " ":
                        out.space(" ")
                    out.ink(t.strip(" "), n)
                    if t[-1:] == " ":
                        out.space(" ")
            elif n.kind == "comment":
                # The line end after a comment is no blank; an empty line is a node of its own.
                previous = _INK.match(s.text, n.end).end()
            elif n.kind == "verbatim":
                out.space("\n" if n.delimiter == "env" else "")
                out.ink(n.content.strip("\n"), n)
                out.space("\n" if n.delimiter == "env" else "")
            elif n.kind == "math":
                formula(n)
            elif n.kind == "environment":
                if n.sig is not None and n.sig.mode == "math" or n.name in ("equation", "equation*", "align", "align*"):
                    formula(n)
                else:
                    out.space("\n")
                    skip = {id(a) for a in n.args or [] if a is not None}
                    visit([c for c in n.children if id(c) not in skip])
                    out.space("\n")
            elif n.kind == "command":
                visit_command(n, nodes, k, used)
            elif n.kind != "option":
                visit(n.children)

    def visit_command(n: Node, nodes: list[Node], k: int, used: set[int]) -> None:
        args = [a for a in n.args or [] if a is not None]
        if n.base in ACCENTS:
            over = args[0] if args else nodes[k + 1] if k + 1 < len(nodes) and not n.args else None
            base = over.children[0] if over is not None and over.kind == "brace" and len(over.children) == 1 else over
            # An accent takes the dot's place.
            letter = "" if base is None or base.kind == "brace" else base.name if base.kind == "command" and base.name in DOTLESS else base.content
            if letter:
                out.ink(unicodedata.normalize("NFC", letter[0] + ACCENTS[n.base]) + letter[1:], n)
                used.add(id(over))
                return
        if n.base in DOTLESS:
            out.ink(DOTLESS[n.base], n)
            return
        if n.base in WORDS:
            word = WORDS[n.base]
            if word[:1] == " ":
                out.space(" ")
            if word.strip():
                out.ink(word.strip(), n)
            if word[-1:] == " ":
                out.space(" ")
            return
        if n.base in ("\\", "par", "newline"):
            out.space("\n\n" if n.base == "par" else "\n")
            used.update(map(id, args))
            return
        used.update(map(id, args))
        if n.base in SILENT:
            return
        if n.base in REFERENCES:
            out.ink("?", n)
            return
        if n.base == "footnote":
            if args:
                out.notes.append((n, args[-1]))
            return
        if n.base == "item":
            out.space("\n")
            for a in args:
                visit(a.children)
                out.space(" ")
            return
        if n.base in SECTIONS or n.base == "caption":
            out.space("\n\n")
        for a, kind in zip(n.args or [], n.sig.kinds if n.sig else (), strict=False):
            if a is not None and kind.mandatory:
                visit(a.children if a.kind == "brace" else [a])
        if n.base in SECTIONS or n.base == "caption":
            out.space("\n\n")

    body = next((c for c in s.root.children if c.kind == "environment" and c.name == "document"), None)
    visit(body.children if body is not None else s.root.children)
    while out.notes:
        (n, a), *out.notes = out.notes
        out.space("\n\n")
        visit(a.children if a.kind == "brace" else [a])
    return "".join(out.parts), out.marks
