"""Definitions of a source text as line ranges, by its structure.

Python is parsed; languages with braces are scanned with strings and comments
masked, Ruby by the indentation of ``end``. A parser may be added to ``PARSERS``:
it takes a text and gives (first line, last line, name), lines from 1, or None
where it can't read the text.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from corvine.functions.languages import BEFORE_BRACKET, FIRST_LETTERS, PATTERNS

Found = list[tuple[int, int, str]] | None

#: What a pattern of calls may take for a name (fixed values).
_KEYWORDS = frozenset(("if", "for", "while", "switch", "catch", "return", "else", "do", "new", "throw", "using", "lock"))
_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?&?(?:\w+::)*(\w+)")
_MASKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.[^'\n]*|[^'\\\n])'", re.S)


def plain_name(name: str) -> str:
    """Without what qualifies it, by the last ``::`` and then the last dot."""
    return name.rsplit("::", 1)[-1].rsplit(".", 1)[-1]


def of_python(text: str) -> Found:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    some = (n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))
    return [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno or n.lineno, n.name) for n in some]


def masked(text: str) -> str:
    """The text with comments and strings as blanks, line ends kept."""
    return _MASKED.sub(lambda m: "\n".join([" " * len(x) for x in m[0].split("\n")]) if "\n" in m[0] else " " * len(m[0]), text)


def _some_lines(lang: str) -> re.Pattern:
    """Finds the lines that a pattern may take: most others are not looked at."""
    ways = [rf"[ \t]*(?:{'|'.join(FIRST_LETTERS[lang] + ['uns'] * (lang == 'rust'))})"]
    if lang in BEFORE_BRACKET:
        ways.append(rf"[\w{re.escape(BEFORE_BRACKET[lang])} \t\v\f\r]*\(")
    if lang == "cpp":
        ways.append(r"[^\n]*template")
    return re.compile(rf"^(?:{'|'.join(ways)})", re.A | re.M)


def of_braces(lang: str) -> Callable[[str], Found]:
    patterns = [re.compile(p, re.A) for p in PATTERNS[lang]]

    some = _some_lines(lang)

    def run(text: str) -> Found:
        clean = masked(text)
        names = []
        for line in some.finditer(clean):
            stop = clean.find("\n", line.start())
            body = clean[line.start() : stop if stop >= 0 else len(clean)]
            name = m[1] if lang == "rust" and (m := _IMPL.match(body)) else next((m[1] for p in patterns if (m := p.match(body))), None)
            if name and name not in _KEYWORDS:
                names.append((line.start(), name))
        if not names:
            return []
        starts = [0, *(m.end() for m in re.finditer("\n", clean))]
        closed, held, stops = {}, [], []
        for m in re.finditer("[{};]", clean):
            if m[0] == "}":
                if held:
                    closed[held.pop()] = m.start()
                continue
            stops.append(m.start())
            if m[0] == "{":
                held.append(m.start())
        out = []
        for s, name in names:
            at = bisect_left(stops, s)
            if at < len(stops) and stops[at] in closed:  # a body before the next semicolon
                out.append((bisect_right(starts, s), bisect_right(starts, closed[stops[at]]), plain_name(name)))
        return out

    return run


def of_ruby(text: str) -> Found:
    patterns = [re.compile(p, re.A) for p in PATTERNS["ruby"]]
    out, held = [], []
    for k, line in enumerate(text.split("\n"), 1):
        depth = len(line) - len(line.lstrip(" \t"))
        word = line.strip(" \t\r")
        if m := next((m for p in patterns if (m := p.match(line))), None):
            held.append((depth, k, m[1]))
        elif re.match(r"end\b", word):
            while held and held[-1][0] > depth:
                held.pop()
            if held and held[-1][0] == depth:
                _, first, name = held.pop()
                out.append((first, k, name))
    return out


PARSERS: dict[str, Callable[[str], Found]] = {"python": of_python, "ruby": of_ruby, **{x: of_braces(x) for x in ("cpp", "javascript", "typescript", "java", "rust", "go", "csharp")}}


def definitions(text: str, lang: str) -> Found:
    """All definitions; None for a language or text that can't be read."""
    return PARSERS[lang](text) if lang in PARSERS else None
