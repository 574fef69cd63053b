"""Top-level declarations of source text.

Python is parsed by its own ``ast`` (a line scanner stands in for text that does not
parse).  C, C++, TypeScript and JavaScript go through one scanner that knows
comments, strings and brackets and judges what stands before an opening brace.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Declaration:
    start: int
    end: int
    kind: str
    name: str | None
    breaks: tuple[int, ...] = ()
    inner: list[Declaration] = field(default_factory=list)


TYPE_KINDS = {"class", "struct", "union", "interface"}


def declarations(text: str, language: str, depth: int = 1) -> list[Declaration]:
    """Declarations in source order, each with ``depth - 1`` levels of its own."""
    if language == "python":
        try:
            return list(_python(ast.parse(text).body, depth))
        except (SyntaxError, ValueError, RecursionError):
            return _python_lines(text)
    return Scanner(text, language).scan(0, len(text), depth)


def _python(body: list[ast.stmt], depth: int) -> Iterator[Declaration]:
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = lambda n: min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]])
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            inner = list(_python(node.body, depth - 1)) if depth > 1 else []
            yield Declaration(first(node), node.end_lineno, kind, node.name, tuple(sorted({first(s) for s in node.body})), inner)


def _python_lines(text: str) -> list[Declaration]:
    found, lines = [], text.split("\n")
    start = None
    for i, line in enumerate([*lines, "end"], 1):
        if not line.strip() or line[0] in " \t#)":
            continue
        if found and found[-1].end == 0:
            found[-1].end = max(k for k in range(found[-1].start, i) if lines[k - 1].strip())
        if line.startswith("@"):
            start = start or i
            continue
        m = re.match(r"(?:async\s+)?(def|class)\s+(\w+)", line)
        if m and i <= len(lines):
            found.append(Declaration(start or i, 0, "class" if m[1] == "class" else "function", m[2]))
        start = None
    return found


_PAIRS = {"(": ")", "[": "]", "{": "}"}
_HEADS = {
    "c": r"(?P<k>struct|union|enum)\s+(?P<n>\w+)?\s*$",
    "cpp": r"(?:template\s*<.*>\s*)?(?P<k>class|struct|union|enum|namespace)(?:\s+(?:class|struct))?(?:\s+(?P<n>[\w:]+))?(?:\s+final)?\s*(?::[^:].*)?$",
    "typescript": r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?P<k>class|interface)\b\s*(?P<n>[\w$]+)?.*$",
    "javascript": r"(?:export\s+)?(?:default\s+)?(?P<k>class)\b\s*(?P<n>[\w$]+)?.*$",
}
_SCRIPT_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<n>[\w$]+)?\s*(?:<.*>)?\s*\(.*$", re.S)
_SCRIPT_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<n>[\w$#]+)\s*(?:<.*>)?\s*\(.*\)\s*(?::.*)?$", re.S)
_C_FUNCTION = re.compile(r"(?P<n>(?:[A-Za-z_~]\w*\s*::\s*)*(?:operator\s*[^\s(]+|~?[A-Za-z_]\w*))\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:const|noexcept|override|final|->.*|:.*|\s)*$", re.S)
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "catch", "return", "sizeof"}


class Scanner:
    def __init__(self, text: str, language: str):
        self.language = language
        self.script = language in ("typescript", "javascript")
        self.text, self.code = text, self._blank(text)
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def _blank(self, text: str) -> str:
        """The text with comments, strings and preprocessor lines blanked out, length kept."""
        quotes = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?" + (r"|`(?:\\.|[^`\\])*`?" if self.script else "")
        lines = "" if self.script else r"|^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*"
        pattern = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{quotes}{lines}", re.S | re.M)
        return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.group()[0] in "/#" or m.group().lstrip().startswith("#") else m.group()[0] + re.sub(r"[^\n]", "_", m.group()[1:]), text)

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def close(self, at: int, end: int) -> int:
        """The place of the bracket that closes the one at ``at``."""
        stack = []
        for i in range(at, end):
            c = self.code[i]
            if c in _PAIRS:
                stack.append(_PAIRS[c])
            elif stack and c == stack[-1]:
                stack.pop()
                if not stack:
                    return i
        return end - 1

    def judge(self, head: str, inside: str | None) -> tuple[str, str | None] | None:
        """Kind and name of what a head before a brace declares."""
        head = head.strip()
        m = re.match(_HEADS[self.language], head, re.S)
        if m and "(" not in head.split(":")[0]:
            return m["k"], m["n"]
        if self.script:
            if m := _SCRIPT_FUNCTION.match(head):
                return "function", m["n"]
            if inside in TYPE_KINDS and (m := _SCRIPT_METHOD.match(head)) and m["n"] not in _NOT_FUNCTIONS:
                return "method", m["n"]
            return None
        body = re.sub(r"^template\s*<.*?>\s*(?=\w)", "", head, flags=re.S)
        if "=" in body.split("(")[0].replace("operator=", "") or body.startswith(("extern", "typedef")) and "(" not in body:
            return None
        m = _C_FUNCTION.search(body)
        if m and m["n"].strip() not in _NOT_FUNCTIONS:
            return "function", re.sub(r"\s+", "", m["n"])
        return None

    def scan(self, at: int, end: int, depth: int, inside: str | None = None) -> list[Declaration]:
        found, begin, i = [], None, at
        while i < end:
            c = self.code[i]
            if c.isspace():
                i += 1
                continue
            if begin is None:
                begin = i
            if c == ";" or c == "}":
                begin = None
            elif c in "([":
                i = self.close(i, end)
            elif c == "{":
                close = self.close(i, end)
                judged = self.judge(self.code[begin:i], inside)
                after = re.match(r"\s*(.?)", self.code[close + 1 : end], re.S)[1]
                # "struct x {...} y;" and "typedef struct {...} x;" declare variables and names
                if judged and judged[0] in ("struct", "union", "enum") and after not in (";", ""):
                    judged = None if self.language == "c" or re.match(r"[\w*]", after) else judged
                if judged:
                    kind = "method" if judged[0] == "function" and inside in TYPE_KINDS else judged[0]
                    inner = self.scan(i + 1, close, depth - 1, judged[0]) if depth > 1 and kind not in ("function", "method", "enum") else []
                    found.append(Declaration(self.line(begin), self.line(close), kind, judged[1], self._breaks(i + 1, close), inner))
                i, begin = close, None if judged or not re.match(r"[\w=(.,\[]", after) else begin
            elif self.script and c == "\n":
                begin = None
            i += 1
        return found

    def _breaks(self, at: int, end: int) -> tuple[int, ...]:
        """Lines on which the statements directly inside a body begin."""
        lines, fresh, i = set(), True, at
        while i < end:
            c = self.code[i]
            if fresh and not c.isspace() and c not in ";}":
                lines.add(self.line(i))
                fresh = False
            if c in _PAIRS:
                i = self.close(i, end)
                fresh = fresh or c == "{"
            elif c == ";":
                fresh = True
            i += 1
        return tuple(sorted(lines))
