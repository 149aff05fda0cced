"""Macro expansion to a fixed point, with the source of every piece of the view."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_right
from dataclasses import dataclass

from scriptorium.functions.kernel import DEFINING, Node, Scanned, Spans, scan
from scriptorium.functions.signatures import Table

_WORD = re.compile(r"(?<!\\)(?:\\\\)*\\[A-Za-z@]+$")
DEPTH, PASSES, GROWTH, SLACK = 8, 16, 16, 100_000


@dataclass(eq=False)
class Piece:
    """view[start:stop] comes from source[source:source_stop]: character by character where expansion is None, else as a whole."""

    start: int
    stop: int
    source: int
    source_stop: int
    expansion: int | None
    depth: int


class Mapped:
    """A text with the piece that each part of it comes from."""

    def __init__(self, text: str, pieces: list[Piece]) -> None:
        self.text, self.pieces, self.starts = text, pieces, [p.start for p in pieces]

    def part(self, a: int, b: int, shift: int) -> list[Piece]:
        """The pieces of text[a:b], moved so that it begins at `shift`."""
        out = []
        for p in itertools.takewhile(lambda p: p.start < b, itertools.islice(self.pieces, max(0, bisect_right(self.starts, a) - 1), None)):
            lo, hi = max(p.start, a), min(p.stop, b)
            if lo < hi:
                exact = p.expansion is None
                out.append(Piece(lo - a + shift, hi - a + shift, p.source + lo - p.start if exact else p.source, p.source + hi - p.start if exact else p.source_stop, p.expansion, p.depth))
        return out

    def expansion_at(self, at: int) -> int | None:
        """The expansion that wrote the place, if any did."""
        k = bisect_right(self.starts, at)
        return self.pieces[k - 1].expansion if k else None

    def cover(self, a: int, b: int) -> tuple[int, int, int]:
        """The source span and the largest depth of text[a:b]."""
        own = self.part(a, b, 0)
        if not own:
            at = next((p.source for p in self.pieces if p.start >= a), len(self.text))
            return at, at, 0
        return min(p.source for p in own), max(p.source_stop for p in own), max(p.depth for p in own)


#: What keeps the next command from being run.
PROTECTING = frozenset("noexpand string meaning show expandafter protect".split())
#: Tests of an argument: what is asked of its source, and which of the two arguments that follow are there.
TESTS = {f"{name}{ends}": (name, ends) for name in ("IfBoolean", "IfNoValue", "IfValue", "IfBlank") for ends in ("TF", "T", "F")}


@dataclass(frozen=True)
class Use:
    """A span to be rewritten: parts are texts, or spans of the same text."""

    start: int
    stop: int
    name: str
    parts: tuple[str | tuple[int, int], ...]


def _span(a: Node) -> tuple[int, int]:
    return a.inner if a.kind in ("brace", "option") and a.inner else (a.start, a.end)


def tested(test: str, given: str) -> bool | None:
    """What a test says of an argument's source; None where that can't be told."""
    given = given.strip()
    if test == "IfBoolean":
        return {"\\BooleanTrue": True, "\\BooleanFalse": False}.get(given)
    if "#" in given:
        return None
    return given == "" if test == "IfBlank" else (given == "-NoValue-") == (test == "IfNoValue")


def _filled(code: str, values: list[str | tuple[int, int]]) -> tuple[str | tuple[int, int], ...]:
    """A body with its parameters replaced."""
    parts: list[str | tuple[int, int]] = []
    at = 0
    for m in _HASH.finditer(code):
        parts.append(code[at : m.start()])
        number = int(m[1]) if m[1] else 0
        parts.append("#" if m[0] == "##" else values[number - 1] if 0 < number <= len(values) else m[0])
        at = m.end()
    return tuple(p for p in (*parts, code[at:]) if p != "")


def _values(n: Node, defaults: tuple) -> list[str | tuple[int, int]]:
    """What stands for each parameter of a use: the star, arguments, their defaults."""
    sig, args = n.sig, n.args or []
    out: list[str | tuple[int, int]] = []
    if sig is not None and sig.starred:
        out.append("\\BooleanTrue" if n.name.endswith("*") and len(n.name) > 1 else "\\BooleanFalse")
    for a, k in zip(args, sig.kinds if sig else (), strict=False):
        default = defaults[len(out)] if len(out) < len(defaults) else None
        if k.kind == "t":
            out.append("\\BooleanTrue" if a is not None else "\\BooleanFalse")
        else:
            out.append(_span(a) if a is not None else default if default is not None else "-NoValue-")
    return out


def _complete(n: Node) -> bool:
    return n.sig is not None and len(n.args or []) == len(n.sig.kinds) and all(a is not None or not k.mandatory for a, k in zip(n.args or [], n.sig.kinds, strict=True))


def _uses(s, keep: frozenset[str]):
    """Complete uses of macros, of environments and of tests outside definitions, outermost only, in order of the text."""
    skip: set[int] = set()
    out: list[Use] = []
    stack = [iter(s.root.children)]
    protected = False
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            continue
        if id(c) in skip:
            continue
        was, protected = protected, c.kind == "command" and c.base in PROTECTING
        if c.kind == "command" and c.base in DEFINING:
            skip.update(id(a) for a in c.args or [] if a is not None)
            continue
        args = [a for a in c.args or [] if a is not None]
        if c.kind == "command" and not c.bare and not was and c.name not in keep and _complete(c):
            code, defaults = c.macro if c.macro is not None else (None, ())
            parts = None
            if code is not None:
                parts = _filled(code, _values(c, defaults))
            elif c.base in TESTS and c.macro is None:
                test, ends = TESTS[c.base]
                answer = tested(test, s.text[slice(*_span(args[0]))])
                if answer is not None:
                    chosen = args[1:][0 if answer else -1] if ends == "TF" else args[1] if answer == (ends == "T") else None
                    parts = (_span(chosen),) if chosen is not None else ()
            if parts is not None:
                skip.update(map(id, args))
                out.append(Use(c.start, max([c.end, *(a.end for a in args)]), c.name, parts))
                continue
        elif c.kind == "environment" and c.body is not None and c.name not in keep and _complete(c) and c.inner:
            begin, end, defaults, _ = c.body
            defaults = defaults if isinstance(defaults, tuple) else (defaults,) + (None,) * len(c.sig.kinds)
            values = _values(c, defaults)
            if begin is not None and end is not None:
                skip.update(map(id, args))
                head = max([c.inner[0], *(a.end for a in args)])
                out.append(Use(c.start, head, c.name, _filled(begin, values)))
                out.append(Use(c.inner[1], c.end, c.name, _filled(end, values)))
        stack.append(iter(c.children))
    return sorted(out, key=lambda u: (u.start, u.stop))


class _View:
    """A text under way, with its pieces; what is written is kept apart from what stood before where TeX would read them together."""

    def __init__(self, now: Mapped) -> None:
        self.now, self.out, self.pieces, self.size, self.tail = now, [], [], 0, ""

    def _add(self, t: str, pieces: list[Piece]) -> None:
        self.out.append(t)
        self.pieces.extend(pieces)
        self.size += len(t)
        self.tail = (self.tail + t)[-200:]

    def copy(self, a: int, b: int) -> None:
        if a < b:
            self._add(self.now.text[a:b], self.now.part(a, b, self.size))

    def write(self, t: str, span: tuple[int, int], number: int, depth: int) -> None:
        if t:
            self._add(t, [Piece(self.size, self.size + len(t), *span, number, depth)])

    def joint(self, t: str) -> str:
        """What must stand between what is written so far and t."""
        if t[:1].isalpha() and _WORD.search(self.tail[-80:]):
            return " "  # a letter would lengthen the control word
        line = self.tail.rpartition("\n")[2]
        if t and _COMMENT.search(line) and t[:1] not in "\r\n":
            return "\n"  # the comment would take it
        if self.tail and not line.strip() and "\n" in self.tail and _BLANK.match(t):
            return "%"  # no paragraph ends here
        return ""


_HASH = re.compile(r"##|#([1-9])")
_COMMENT = re.compile(r"(?<!\\)(?:\\\\)*%")
_BLANK = re.compile(r"[ \t]*\r?\n")


def expand(text: str, table: Table | None = None, *, depth: int = DEPTH, keep: frozenset[str] = frozenset(), package: bool = False, files: dict | None = None, path: str | None = None) -> tuple[str, list[Piece], list[dict]]:
    """(view, pieces, expansions): the text with uses of its macros replaced by their bodies, until none is left or a bound is met."""
    return expanded(text, table, depth=depth, keep=keep, package=package, files=files, path=path)[:3]


def expanded(text: str, table: Table | None = None, *, depth: int = DEPTH, keep: frozenset[str] = frozenset(), package: bool = False, files: dict | None = None, path: str | None = None) -> tuple[str, list[Piece], list[dict], Scanned]:
    """expand(), and the scan of the view."""
    now = Mapped(text, [Piece(0, len(text), 0, len(text), None, 0)] if text else [])
    expansions: list[dict] = []
    for _ in range(PASSES):
        s = scan(now.text, table, package=package, files=files, path=path)
        view, at, changed = _View(now), 0, False
        discarded = Spans((b.start, b.stop) for b in s.branches if b.taken is False)
        for use in _uses(s, keep):
            if use.start in discarded or use.start < at:
                continue
            source, source_stop, deep = now.cover(use.start, use.stop)
            if deep >= depth:
                continue
            changed = True
            view.copy(at, use.start)
            number, span = len(expansions), (source, source_stop)
            expansions.append({"expansion_id": number, "parent_id": now.expansion_at(use.start), "name": use.name, "source": source, "source_stop": source_stop, "depth": deep + 1})
            for part in use.parts:
                t = part if isinstance(part, str) else now.text[slice(*part)]
                view.write(view.joint(t), span, number, deep + 1)
                if isinstance(part, str):
                    view.write(t, span, number, deep + 1)
                else:
                    view.copy(*part)
            at = use.stop
            view.write(view.joint(now.text[at : at + 200]), span, number, deep + 1)
        view.copy(at, len(now.text))
        if not changed or view.size > GROWTH * len(text) + SLACK:
            break
        now = Mapped("".join(view.out), view.pieces)
    else:
        s = scan(now.text, table, package=package, files=files, path=path)
    return now.text, now.pieces, expansions, s
