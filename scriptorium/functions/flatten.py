"""A scanned document as rows: nodes with nested-set numbers and inherited context, events, definitions and inclusions."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from operator import attrgetter

from scriptorium.functions import expand as expansion
from scriptorium.functions import mathlists
from scriptorium.functions.kernel import DEFINING, LINE, Node, Scanned, Spans, scan, walk
from scriptorium.functions.signatures import ALIGNMENTS, FLOATS, INNER, LISTS, MATH_ENVIRONMENTS, ROWWISE, TABLES, PROSE_OPTIONS, Table, content_of

TEXT_IN_MATH = frozenset("text mbox hbox textrm textbf textit texttt textsf intertext".split())
INCLUDING = {"input": ".tex", "include": ".tex", "usepackage": ".sty", "RequirePackage": ".sty", "documentclass": ".cls", "LoadClass": ".cls", "includegraphics": ""}

#: Arguments that are boxes: no float may stand in them.
BOXES = frozenset("mbox fbox hbox makebox framebox parbox raisebox footnote footnotetext marginpar vbox".split())
#: What leaves a row or a cell of a table as it is.
SILENT = frozenset("hline cline toprule midrule bottomrule cmidrule noalign label rowcolor addlinespace".split())
BREAKS = frozenset(("\\", "tabularnewline", "cr"))
#: Commands that typeset nothing, before the first item of a list.
INKLESS = frozenset("small footnotesize scriptsize tiny normalsize large Large setlength addtolength setcounter addtocounter stepcounter label itemsep parskip centering raggedright sloppy relax par vspace hspace color bfseries itshape sffamily ttfamily".split())
TRACKED = ALIGNMENTS | LISTS
INK = frozenset("textbf textit texttt textsc textsf textsl textrm emph underline footnote mbox fbox ref cite includegraphics".split())

CTX = "mode string, lists boolean, alignment boolean, floating boolean, boxed boolean, body boolean, arg_of string, math_id int, env string, tags boolean, defining boolean, discarded boolean, itemize int, enumerate int, nested int"
#: Where a node stands in its table, list or formula: `lead` is what nothing was typeset in before it (row, cell or neither), `cells` the columns
#: that its row has, told at the row's end, `spec` the table's own argument there; `nth` of a label or tag in its equation; `pair` of a delimiter,
#: `across` where the end of a cell comes between; `first` the first ink where there should be none.
PLACE = "after_par boolean, lead string, cells int, spec string, nth int, pair int, across boolean, first boolean"
NODE = f"node_id int, parent_id int, sib int, depth int, last int, kind string, name string, base_name string, star boolean, content string, delimiter string, start int, stop int, inner_start int, inner_stop int, line int, col int, end_line int, end_col int, mode string, spec string, args array<int>, given array<string>, bare boolean, closed boolean, macro boolean, role string, value boolean, by string, ctx struct<{CTX.replace(' ', ':').replace(',:', ',')}>, place struct<{PLACE.replace(' ', ':').replace(',:', ',')}>"
EVENT = "code string, severity string, message string, start int, stop int, line int, col int, end_line int, end_col int, fix_at int, fix string, by string"
DEFINITION = "start int, how string, name string, arity int, default string, body string, highest int, known boolean, stop int, line int, col int, by string"
BRANCH = "condition int, start int, stop int, second boolean, taken boolean"
INCLUSION = "start int, stop int, line int, col int, command string, target string, extension string, by string"
CHANGE = "start int, character string, category int, everywhere boolean"


def _struct(fields: str) -> str:
    """A DDL list of fields, whose own types hold no blanks, as a struct."""
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


PARTS = ("nodes", "events", "definitions", "branches", "inclusions", "changes", "counters")
PARSED = "doc_id long, text string, fragment boolean, class string, packages array<string>, counters array<string>, " + ", ".join(f"{name} array<{_struct(fields)}>" for name, fields in (("nodes", NODE), ("events", EVENT), ("definitions", DEFINITION), ("branches", BRANCH), ("inclusions", INCLUSION), ("changes", CHANGE)))


def _inner(node: Node, ctx: dict, arg_of: str | None, content: str = "prose") -> dict:
    """The context inside a group, given that of the group and what it holds as an argument; None stands for what isn't known."""
    if content == "name":  # no rule of text or of formulas speaks there
        return dict(ctx, mode=None, lists=None, alignment=None, floating=None, arg_of=arg_of or ctx["arg_of"])
    if content == "formula":
        return dict(ctx, mode="math", alignment=False, tags=False, arg_of=arg_of or ctx["arg_of"])
    if node.kind in ("brace", "option") and (arg_of is None or arg_of == ctx["arg_of"]) and arg_of not in ("", *BOXES):
        return ctx
    out = dict(ctx, tags=ctx["tags"] and node.kind != "math", arg_of=arg_of if node.kind in ("brace", "option") and arg_of else ctx["arg_of"] if node.kind in ("brace", "option") else None)
    if node.kind == "math":
        return dict(out, mode="math", math_id=node.index, alignment=False, tags=node.delimiter in ("\\[", "$$"))
    if node.kind == "environment":
        out["env"] = node.name
        if node.name == "document":
            out.update(body=True)
        if node.name in LISTS:
            out.update(lists=True, nested=ctx["nested"] + 1)
            if node.name in out:
                out[node.name] = ctx[node.name] + 1
        if node.name in FLOATS:
            out.update(floating=True, boxed=True)
        if node.name == "minipage" or node.name in TABLES:
            out["boxed"] = True
        if node.name in INNER:
            out["tags"] = False
        if node.name in ALIGNMENTS or node.name in MATH_ENVIRONMENTS:
            out["alignment"] = node.name in ALIGNMENTS or node.name.startswith(("gather", "multline")) and None
        if node.name in MATH_ENVIRONMENTS:
            out.update(mode="math", math_id=node.index, tags=node.name != "math")
        elif node.sig is None:
            out.update(mode=None, lists=None, alignment=None, floating=None, boxed=None)
        elif node.sig.mode == "math":
            out.update(mode="math")
        elif node.name in TABLES or node.name == "minipage":
            out["mode"] = "text"
        return out
    if arg_of is not None:
        if arg_of == "":  # of an unknown command
            out.update(mode=None, lists=None, alignment=None, floating=None, boxed=None)
        elif arg_of in TEXT_IN_MATH:
            out.update(mode="text", math_id=None, alignment=False)
        elif arg_of in DEFINING:
            out.update(defining=True, mode=None, lists=None, alignment=None, floating=None, boxed=None, body=None)
        if arg_of in BOXES:
            out["boxed"] = True
    return out


#: The place of a node of which there is nothing to say.
PLAIN = {"after_par": None, "lead": None, "cells": None, "spec": None, "nth": None, "pair": None, "across": None, "first": None}
_BROKEN = frozenset(("\\", "\\*", "newline"))


class _Places:
    """Where the children of a table, a list or a part of a formula stand: their rows, cells, items and delimiters."""

    def __init__(self, group: Node, spec: str | None) -> None:
        self.table = group.kind == "environment" and group.name in ALIGNMENTS
        self.list = group.kind == "environment" and group.name in LISTS
        self.spec, self.opened, self.excused = spec, [], 0
        self.row_empty, self.cell_empty, self.columns, self.items, self.inked = True, True, 1, 0, False
        self.owned: set[int] = {id(a) for a in group.args or [] if a is not None}
        self.last: dict | None = None  # the row's last node so far

    def place(self, n: Node) -> dict:
        if n.kind == "comment":
            return PLAIN
        command = n.kind == "command"
        out = dict(PLAIN) if self.table or (command and n.name in ("left", "middle", "right")) else PLAIN
        mine = id(n) not in self.owned
        if command and n.args:
            self.owned.update(id(a) for a in n.args if a is not None)
        if out is not PLAIN and command and not n.bare:
            if n.name == "left":
                self.opened.append((n.index, out))
            elif n.name in ("right", "middle") and self.opened:
                out["pair"] = self.opened[-1][0]
                if n.name == "right":
                    self.opened.pop()[1]["pair"] = n.index
            elif n.name == "right" and self.excused:
                self.excused -= 1
                out["across"] = True
        if self.table and mine:
            self._cell(n, out)
            if self.opened and ((n.kind == "text" and "&" in n.content) or (command and n.base in BREAKS)):
                for _, left in self.opened:
                    left["across"] = True
                self.excused += len(self.opened)
                self.opened.clear()
        if self.list and mine:
            if command and n.base == "item":
                self.items += 1
            elif not self.items and not self.inked and ((n.kind in ("text", "math", "verbatim") and not n.is_par()) or (command and n.base in INK)):
                self.inked = True
                out = dict(out, first=True)
        return out

    def _cell(self, n: Node, out: dict) -> None:
        out["lead"] = "row" if self.row_empty else "cell" if self.cell_empty else ""
        if n.kind == "command" and n.base in BREAKS:
            self.finish(out)
            return
        self.last = out
        if n.kind == "text":
            parts = n.content.split("&")
            self.columns += len(parts) - 1
            if len(parts) > 1:
                self.cell_empty = True
            if len(parts) > 1 or parts[0].strip():
                self.row_empty = False
            if parts[-1].strip():
                self.cell_empty = False
        elif n.kind == "command" and n.base == "multicolumn":
            width = n.args[0] if n.args else None
            wide = width.children[0].content if width is not None and width.kind == "brace" and len(width.children) == 1 else ""
            self.columns += int(wide) - 1 if wide.isdigit() else 0
            self.row_empty = self.cell_empty = False
        elif not (n.kind == "command" and n.base in SILENT):
            self.row_empty = self.cell_empty = False

    def finish(self, out: dict | None) -> None:
        """A row ends at this place."""
        out = out or self.last
        if out is not None and self.table:
            out["cells"], out["spec"] = self.columns, self.spec
        self.row_empty, self.cell_empty, self.columns, self.last = True, True, 1, None


def _source(s: Scanned, n: Node) -> str:
    """The source of an argument, without its braces or brackets."""
    return s.text[n.inner[0] : n.inner[1]] if n.inner and n.kind in ("brace", "option") else s.text[n.start : n.end]


def rows(s: Scanned, origin: Origin | None = None) -> tuple[list, ...]:
    """The PARTS of a scanned text. origin: where the places of a view come from; all places are then told of the source."""
    nodes: list[dict] = []
    order = list(walk(s.root))
    last = [n.index for n, *_ in order]
    for n, parent, *_ in reversed(order):
        if parent is not None:
            last[parent.index] = max(last[parent.index], last[n.index])
    unknown = None if s.fragment else False
    start = {"mode": "text", "lists": unknown, "alignment": unknown, "floating": unknown, "boxed": unknown, "body": unknown, "arg_of": None, "math_id": None, "env": None, "tags": False, "defining": False, "discarded": False, "itemize": 0, "enumerate": 0, "nested": 0}
    inside: dict[int, dict] = {}
    owner: dict[int, str] = {}
    held: dict[int, str] = {}
    places: dict[int, _Places] = {}
    numbered: Counter = Counter()
    row_of: Counter = Counter()
    scope: dict[int, int | None] = {}  # the display whose rows have numbers, of each group
    included, texted = [], False
    discarded = Spans((b.start, b.stop) for b in s.branches if b.taken is False)
    at = origin.place if origin else lambda a, b: (a, b, *s.position(a), *s.position(b), None)
    for n, parent, sib, depth in order:
        ctx = inside[parent.index] if parent is not None else start
        if discarded and not ctx["discarded"] and n.start in discarded:
            ctx = dict(ctx, discarded=True, defining=True, mode=None, lists=None, alignment=None, floating=None, boxed=None, body=None)
        if n.args and not (n.kind == "command" and n.base in DEFINING):
            before = 0
            for a, kind in zip(n.args, n.sig.kinds if n.sig else (), strict=False):
                if a is not None:
                    held[id(a)] = content_of(n.base, kind, before) if n.kind == "command" else "prose" if n.name in PROSE_OPTIONS else "name"
                before += kind.mandatory
        if n.kind == "command":
            for a in n.args or []:
                if a is not None:
                    owner[id(a)] = n.base
        if parent is not None and sib and n.kind in ("brace", "option") and id(n) not in owner:
            k = sib - 1
            while k >= 0 and parent.children[k].kind in ("brace", "option"):
                k -= 1
            if k >= 0 and parent.children[k].kind == "command" and parent.children[k].sig is None and parent.children[k].name not in ("begin", "end"):
                owner[id(n)] = ""
        given = [None if a is None else _source(s, a) for a in n.args] if n.args else None
        if n.children or n.kind == "root":
            inside[n.index] = _inner(n, ctx, owner.get(id(n)), held.get(id(n), "prose")) if parent is not None else start
            if inside[n.index]["mode"] != "text" or n.name in TRACKED:
                places[n.index] = _Places(n, next((g for g in reversed(given or []) if g is not None), None))
            scope[n.index] = n.index if n.name in ROWWISE and n.kind == "environment" else scope.get(parent.index) if parent is not None else None
        tracker = places.get(parent.index) if parent is not None else None
        place = tracker.place(n) if tracker is not None else PLAIN
        base = n.base
        if parent is not None and n.kind == "command" and not n.bare and not ctx["defining"]:
            if n.name in _BROKEN and ctx["mode"] == "text":
                before = next((c for c in reversed(parent.children[:sib]) if c.kind != "comment"), None)
                if before is not None and before.is_par():
                    place = dict(place, after_par=True)
            if base in BREAKS and parent.index == scope.get(parent.index):
                row_of[parent.index] += 1
            elif base in ("label", "tag") and ctx["math_id"] is not None:
                rowwise = scope.get(parent.index)
                key = (ctx["math_id"] if rowwise is None else rowwise, row_of[rowwise], base)
                numbered[key] += 1
                place = dict(place, nth=numbered[key]) if place is PLAIN else place
                place["nth"] = numbered[key]
        if parent is s.root and n.kind == "command" and n.name == "begin":
            texted = True  # of an environment that is never closed: what follows is not in the preamble
        if parent is s.root and not texted and ctx["body"] is False and not ctx["defining"] and id(n) not in owner and n.kind == "text" and n.content:
            texted, place = True, dict(place, first=True)
        if tracker is not None and n is parent.children[-1]:
            tracker.finish(None)
        source_start, source_stop, line, col, end_line, end_col, by = at(n.start, n.end)
        named = next((g for g, k in zip(given or (), n.sig.kinds if n.sig else (), strict=False) if g is not None and k.mandatory), None) if base in INCLUDING else None
        if named is not None and n.kind == "command" and not ctx["defining"]:
            target = named.strip()
            for t in target.split(",") if INCLUDING[n.base] in (".sty",) else [target]:
                included.append({"start": source_start, "stop": source_stop, "line": line, "col": col, "command": n.base, "target": t.strip(), "extension": INCLUDING[n.base], "by": by})
        nodes.append({
            "node_id": n.index, "parent_id": parent.index if parent is not None else None, "sib": sib, "depth": depth, "last": last[n.index], "kind": n.kind, "name": n.name, "base_name": base, "star": n.kind == "command" and base != n.name,
            "content": n.content, "delimiter": n.delimiter, "start": source_start, "stop": source_stop, "inner_start": n.inner[0] if n.inner else None, "inner_stop": n.inner[1] if n.inner else None, "line": line, "col": col, "end_line": end_line, "end_col": end_col,
            "mode": n.sig.mode if n.sig else None, "spec": n.sig.spec() if n.sig else None, "args": n.args, "given": given, "bare": n.bare, "closed": n.closed, "macro": n.macro is not None, "role": n.role, "value": n.value, "by": by, "ctx": ctx, "place": place,
        })
    for r in nodes:
        if r["args"] is not None:
            r["args"] = [None if a is None else a.index for a in r["args"]]
    events = []
    for e in sorted(s.events + [e for e in mathlists.read(s.root, s.text) if e.start not in discarded], key=lambda e: (e.start, e.end, e.code)):
        source_start, source_stop, line, col, end_line, end_col, by = at(e.start, e.end)
        fix_at = e.fix_at if origin is None or e.fix_at is None else origin.exact(e.fix_at)
        events.append({"code": e.code, "severity": e.severity, "message": e.message, "start": source_start, "stop": source_stop, "line": line, "col": col, "end_line": end_line, "end_col": end_col, "fix_at": fix_at, "fix": e.fix if fix_at is not None else None, "by": by})
    ends = {n.start: n.end for n, *_ in order if n.kind == "command"}
    definitions = []
    for d in s.definitions:
        row = dict(zip(("start", "how", "name", "arity", "default", "body", "highest", "known"), d, strict=True))
        source_start, source_stop, line, col, _, _, by = at(row["start"], ends.get(row["start"], row["start"]))
        definitions.append(row | {"start": source_start, "stop": source_stop, "line": line, "col": col, "by": by})
    branches = [{"condition": b.condition.index, "start": b.start, "stop": b.stop, "second": b.second, "taken": b.taken} for b in s.branches]
    changes = [dict(zip(("start", "character", "category", "everywhere"), c, strict=True)) for c in s.changes]
    counters = [c for c in ("MaxMatrixCols",) if c in s.text]
    return nodes, events, definitions, branches, included, changes, counters


def parsed(doc_id, text: str, table: Table | None, package: bool = False, files: dict | None = None, path: str | None = None, expanded: bool = False) -> dict:
    """A row of PARSED. expanded: of the document's view, with all places told of its source."""
    origin = None
    if expanded:
        # The last pass of the expansion has scanned the view.
        _, pieces, made, s = expansion.expanded(text, table, package=package, files=files, path=path)
        origin = Origin(text, pieces, made) if made else None
    else:
        s = scan(text, table, package=package, files=files, path=path)
    return {"doc_id": doc_id, "text": text, "fragment": s.fragment, "class": s.document_class, "packages": sorted(s.packages)} | dict(zip(PARTS, rows(s, origin), strict=True))


#: Columns of NODE that need no context, and `env`, the environment that a node stands in.
PLAIN_COLUMNS = tuple("node_id parent_id sib depth last kind name base_name content delimiter start stop line col end_line end_col args bare closed inner_start inner_stop".split())
PLAIN_NODE = {f.split(" ", 1)[0]: f for f in NODE.split(", ") if f.split(" ", 1)[0] in PLAIN_COLUMNS} | {"env": "env string"}


def plain_rows(s: Scanned, out: dict[str, list]) -> int:
    """Adds a scanned text's nodes to the columns of out (names of PLAIN_NODE), as rows() tells them, and returns how many; nothing else is made."""
    nodes, parents, sibs, depths = zip(*walk(s.root), strict=True)
    n = len(nodes)
    made: dict[str, list] = {}
    for c, column in out.items():
        if c in ("kind", "name", "content", "delimiter", "start", "bare", "closed"):
            column.extend(map(attrgetter(c), nodes))
        elif c == "node_id":
            column.extend(range(n))
        elif c == "parent_id":
            column.extend([None if p is None else p.index for p in parents])
        elif c == "args":
            column.extend([None if x.args is None else [None if a is None else a.index for a in x.args] for x in nodes])
        elif c in ("inner_start", "inner_stop"):
            column.extend([x.inner[c == "inner_stop"] if x.inner else None for x in nodes])
        elif c in ("sib", "depth"):
            column.extend(sibs if c == "sib" else depths)
        elif c == "base_name":
            column.extend([x.base for x in nodes])
        elif c == "stop":
            column.extend([x.end for x in nodes])
        elif c in ("line", "col", "end_line", "end_col"):
            at = "end" if c.startswith("end") else "start"
            if at not in made:
                made[at] = [s.position(getattr(x, at)) for x in nodes]
            column.extend([p[c.endswith("col")] for p in made[at]])
        elif c == "last":
            last = list(range(n))
            for k in range(n - 1, 0, -1):
                p = parents[k].index
                last[p] = max(last[p], last[k])
            column.extend(last)
        elif c == "env":
            env: list[str | None] = []
            for p in parents:
                env.append(None if p is None else p.name if p.kind == "environment" else env[p.index])
            column.extend(env)
    return n


class Origin:
    """The source places of a view's."""

    def __init__(self, text: str, pieces: list, made: list[dict]) -> None:
        self.pieces, self.starts, self.names, self.size = pieces, [p.start for p in pieces], [e["name"] for e in made], len(text)
        self.lines = [m.start() for m in LINE.finditer(text)] or [0]

    def position(self, off: int) -> tuple[int, int]:
        line = bisect_right(self.lines, off)
        return (line, off - self.lines[line - 1]) if line else (1, 0)

    def piece(self, off: int):
        return self.pieces[max(0, bisect_right(self.starts, off) - 1)] if self.pieces else None

    def exact(self, off: int) -> int | None:
        """The source's own place, if the source wrote it; a place after the last piece follows it."""
        p = self.piece(off)
        if p is not None and p.start == off and p.expansion is not None and off > 0:
            p = self.piece(off - 1)
        return None if p is None or p.expansion is not None else p.source + off - p.start

    def place(self, start: int, stop: int) -> tuple:
        a, b = self.piece(start), self.piece(max(start, stop - 1))
        if a is None:
            return 0, 0, 1, 0, 1, 0, None
        begin = a.source if a.expansion is not None else min(a.source + start - a.start, self.size)
        end = b.source_stop if b.expansion is not None else min(b.source + stop - b.start, self.size)
        return begin, end, *self.position(begin), *self.position(end), None if a.expansion is None else self.names[a.expansion]
