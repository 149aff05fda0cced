"""Rules of formulas that read a list from left to right: scripts, fractions, limits and delimiters."""

from __future__ import annotations

import re

from scriptorium.functions.kernel import Event, Node
from scriptorium.functions.signatures import MATH_ENVIRONMENTS, SIZED

#: TeX's generalised fractions, operators, what leaves the last atom alone, and names of delimiters.
FRACTIONS = frozenset("over atop above choose brace brack overwithdelims atopwithdelims abovewithdelims".split())
OPERATORS = frozenset("sum prod int oint iint iiint coprod bigcup bigcap bigoplus bigotimes bigvee bigwedge bigsqcup biguplus bigodot lim limsup liminf max min sup inf det gcd Pr mathop operatorname limits nolimits displaylimits".split())
TRANSPARENT = frozenset("displaystyle textstyle scriptstyle scriptscriptstyle label nonumber notag".split())
DELIMITERS = frozenset("{ } | langle rangle lvert rvert lVert rVert lfloor rfloor lceil rceil uparrow downarrow updownarrow Uparrow Downarrow Updownarrow vert Vert backslash lbrace rbrace lbrack rbrack lgroup rgroup lmoustache rmoustache ulcorner urcorner llcorner lrcorner".split())
_AFTER = re.compile(r"\s*(?:\\([A-Za-z]+|.)|(.))", re.S)


def read(root: Node, text: str) -> list[Event]:
    """The events of every list in a formula below root."""
    out: list[Event] = []

    def say(code: str, message: str, start: int, stop: int) -> None:
        out.append(Event(code, "error", message, start, stop))

    def a_list(nodes: list[Node], inherited: bool) -> None:
        base, sup, sub, waiting, fractions = False, False, False, None, 0
        operator = inherited and False
        skip: set[int] = set()

        def atom(is_operator: bool = False) -> None:
            nonlocal base, sup, sub, waiting, operator
            if waiting is not None:
                waiting = None
            else:
                base, sup, sub = True, False, False
                operator = is_operator

        def script(c: str, at: int) -> None:
            nonlocal sup, sub, waiting
            if waiting is not None:
                say("script-without-argument", f"{waiting[0]} takes nothing", waiting[1], waiting[1] + 1)
            if c == "^":
                if sup is True:
                    say("double-superscript", "a second superscript", at, at + 1)
                sup = True
            else:
                if sub:
                    say("double-subscript", "a second subscript", at, at + 1)
                sub = True
            waiting = (c, at)

        def finish() -> None:
            nonlocal base, sup, sub, waiting, operator
            if waiting is not None:
                say("script-without-argument", f"{waiting[0]} takes nothing", waiting[1], waiting[1] + 1)
            base, sup, sub, waiting, operator = False, False, False, None, False

        for n in nodes:
            if id(n) in skip or n.kind == "comment":
                continue
            if n.kind == "text":
                for k, c in enumerate(n.content):
                    if c in "^_":
                        script(c, n.start + k)
                    elif c == "&":
                        finish()
                        fractions = 0
                    elif c == "'":
                        if waiting is None and sup is True:
                            say("double-superscript", "a prime after a superscript", n.start + k, n.start + k + 1)
                        elif waiting is not None:
                            atom()
                        else:
                            sup = "prime"
                    elif not c.isspace() and c != "~":
                        atom()
            elif n.kind == "command":
                args = [a for a in n.args or [] if a is not None]
                skip.update(map(id, args))
                if n.base in ("\\", "cr", "tabularnewline"):
                    finish()
                    fractions = 0
                elif n.base in SIZED:
                    m = _AFTER.match(text, n.end)
                    if m is None or (m[1] is None and m[2] not in "()[]|/<>.\u2329\u232a") or (m[1] is not None and m[1] in ("begin", "end", ")", "]", "right", "left")):
                        say("missing-delimiter", f"\\{n.base} has no delimiter", n.start, n.end)
                    if n.base.endswith("ight") or n.base not in ("left",):
                        atom()
                elif n.base in ("limits", "nolimits"):
                    if not operator and base:
                        say("limits-without-operator", f"\\{n.base} after what is no operator", n.start, n.end)
                elif n.base in FRACTIONS:
                    fractions += 1
                    if fractions > 1:
                        say("ambiguous-fraction", f"\\{n.base} in a list that has a fraction", n.start, n.end)
                    finish()
                elif n.base not in TRANSPARENT and not (n.base in (",", ";", ":", "!", " ", "quad", "qquad")):
                    atom(n.base in OPERATORS or n.sig is None)
            else:
                atom(n.kind == "brace" and len(n.children) == 1 and n.children[0].kind == "command")
        finish()

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, math = stack.pop()
        inside = math or n.kind == "math" or (n.kind == "environment" and (n.name in MATH_ENVIRONMENTS or (n.sig is not None and n.sig.mode == "math")))
        blocked: set[int] = set()
        for c in n.children:
            if c.kind == "command" and c.base in ("text", "mbox", "hbox", "textrm", "label", "tag", "intertext", "ref", "eqref", "newcommand", "def", "renewcommand", "operatorname"):
                blocked.update(id(a) for a in c.args or [] if a is not None)
        if inside and n.kind in ("math", "brace", "environment"):
            skip = {id(a) for a in n.args or [] if a is not None}
            a_list([c for c in n.children if id(c) not in skip], math)
        stack.extend((c, inside and id(c) not in blocked) for c in n.children if c.children and not (id(c) in blocked and c.kind != "math" and not c.children))
    out.sort(key=lambda e: (e.start, e.end, e.code))
    return out
