"""Declarations of Python, JavaScript and TypeScript files.

Python files are read by the standard parser; a file it rejects is read line by line instead, so that what comes
before and after an error is still found.  JavaScript and TypeScript are read by a scanner that knows strings,
templates, comments and brackets and looks at statements of the top level and of class bodies.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark import values as V

NODE = "struct<type:string,name:string,line_start:int,line_end:int,language:string,parent:string,params:array<string>,return_type:string,docstring:string,exports:boolean,text:string>"
FIELDS = ("type", "name", "line_start", "line_end", "language", "parent", "params", "return_type", "docstring", "exports", "text")


def node(**given) -> tuple:
    return tuple(given.get(f) for f in FIELDS)


def parse_python(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(source)
    lines = source.split("\n")
    out: list[tuple] = []

    def add(item, kind, name, parent=None, **more):
        first = min([item.lineno, *(d.lineno for d in getattr(item, "decorator_list", []))])
        text = "\n".join(lines[first - 1 : item.end_lineno])
        out.append(node(type=kind, name=name, line_start=first, line_end=item.end_lineno, language="python", parent=parent, text=text, **more))

    def walk(body, parent):
        for item in body:
            if isinstance(item, (ast.Import, ast.ImportFrom)):
                add(item, "import", None)
            elif isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = item.args
                named = [x.arg for x in [*a.posonlyargs, *a.args]] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
                result = ast.get_source_segment(source, item.returns) if item.returns else None
                add(item, "method" if parent else "function", item.name, parent, params=[n for n in named if n not in ("self", "cls")], return_type=result, docstring=ast.get_docstring(item))
            elif isinstance(item, ast.ClassDef):
                add(item, "class", item.name, docstring=ast.get_docstring(item))
                walk(item.body, item.name)
            elif isinstance(item, ast.Assign) and parent is None and isinstance(item.targets[0], ast.Name):
                add(item, "constant", item.targets[0].id)
            elif isinstance(item, ast.AnnAssign) and parent is None and isinstance(item.target, ast.Name):
                add(item, "constant", item.target.id)

    walk(tree.body, None)
    return out


_PY_HEAD = re.compile(r"^([ \t]*)(?:(?:async[ \t]+)?def[ \t]+(?P<function>\w+)|class[ \t]+(?P<class>\w+)|(?P<import>import|from)[ \t]|(?P<constant>[A-Za-z_]\w*)[ \t]*(?::[^=]+)?=(?!=))")


def _python_lines(source: str) -> list[tuple]:
    """Declarations by their first lines and indentation alone."""
    lines, out, inside = source.split("\n"), [], None
    for n, line in enumerate(lines):
        m = _PY_HEAD.match(line)
        if not m:
            continue
        indent = len(m.group(1).expandtabs())
        if indent == 0:
            inside = m["class"]
        if indent and not (m["function"] and inside):
            continue
        end = n + 1
        if not m["import"] and not m["constant"]:
            while end < len(lines) and (not lines[end].strip() or len(lines[end].expandtabs()) - len(lines[end].expandtabs().lstrip()) > indent):
                end += 1
            while end > n + 1 and not lines[end - 1].strip():
                end -= 1
        kind = "import" if m["import"] else "constant" if m["constant"] else "class" if m["class"] else "method" if indent else "function"
        name = m["function"] or m["class"] or m["constant"]
        out.append(node(type=kind, name=name, line_start=n + 1, line_end=end, language="python", parent=inside if kind == "method" else None, text="\n".join(lines[n:end])))
    return out


_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[{}()\[\];]""", re.S)
_STATEMENT = re.compile(
    r"(?P<export>export\s+(?:default\s+)?)?(?:(?P<import>import\b(?!\s*\())|(?:declare\s+)?(?:(?:async\s+)?function\s*(?P<star>\*)?\s*(?P<function>[\w$]*)|(?:abstract\s+)?class\s+(?P<class>[\w$]+)|interface\s+(?P<interface>[\w$]+)|type\s+(?P<alias>[\w$]+)\s*(?:<[^=]*>)?\s*=|(?P<variable>const|let)\s+(?P<constant>[\w$]*)))"
)
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^({]*>)?\s*\(")


def _close(text: str, at: int, stop: int) -> int:
    """The end of the bracket that opens at ``at``, or ``stop``."""
    depth = 0
    for m in _SKIP.finditer(text, at, stop):
        depth += m.group() in "([{"
        if m.group() in ")]}":
            depth -= 1
            if depth == 0:
                return m.end()
    return stop


def _statement_end(text: str, at: int, stop: int, block: bool) -> int:
    """The end of a statement: behind its first block, or its semicolon or line outside brackets."""
    depth, last = 0, at
    for m in _SKIP.finditer(text, at, stop):
        sign = m.group()
        if not block and depth == 0 and (cut := re.search(r"[^\s,=+\-*/|&?:(<.][ \t]*\n(?=[^\s.?:|&=+])", text[last : m.start()])):
            return last + cut.start() + 1
        last = m.end()
        if sign in "([{":
            depth += 1
        elif sign in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
            if depth == 0 and sign == "}" and block:
                return m.end()
        elif sign == ";" and depth == 0:
            return m.end()
    if not block and (cut := re.search(r"[^\s,=+\-*/|&?:(<.][ \t]*\n(?=[^\s.?:|&=+])", text[last:stop])):
        return last + cut.start() + 1
    return stop


def _comment_before(text: str, at: int) -> str | None:
    """The text of the comment right before a declaration."""
    before = text[:at].rstrip()
    if before.endswith("*/"):
        inner = before[before.rfind("/*") + 2 : -2]
        return "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in inner.lstrip("*").strip().split("\n")).strip() or None
    line = before[before.rfind("\n") + 1 :].strip()
    return line[2:].strip() or None if line.startswith("//") else None


def _signature(text: str, at: int, stop: int) -> tuple[list[str], str | None]:
    """Parameters and result type from the bracket at ``at`` on."""
    end = _close(text, at, stop)
    params, depth, held = [], 0, ""
    for c in text[at + 1 : end - 1]:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            params.append(held)
            held = ""
        else:
            held += c
    names = [re.split(r"[?:=]", p.strip())[0].strip() for p in [*params, held]]
    result = re.compile(r"\s*:\s*([^{;]+?)\s*(?=[{;]|$)").match(text, end, stop)
    return [n for n in names if n], result.group(1) if result else None


def parse_script(source: str, language: str) -> list[tuple]:
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    line = lambda at: bisect_right(starts, at)
    out: list[tuple] = []

    def add(kind, name, first, end, parent=None, **more):
        text = source[first:end].rstrip()
        out.append(node(type=kind, name=name or None, line_start=line(first), line_end=line(first + max(0, len(text) - 1)), language=language, parent=parent, text=text, **more))

    at, stop = 0, len(source)
    blank = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
    while at < stop:
        if skipped := blank.match(source, at):
            at = skipped.end()
            continue
        m = _STATEMENT.match(source, at)
        if not m:
            at = max(at + 1, _statement_end(source, at, stop, False))
            continue
        exported = bool(m["export"])
        block = bool(m["class"] or m["interface"] or m["function"] is not None)
        end = _statement_end(source, m.end(), stop, block)
        comment = None if m["import"] else _comment_before(source, at)
        if m["import"]:
            if not exported:
                add("import", None, at, end)
        elif m["function"] is not None:
            if not m["star"]:
                bracket = source.find("(", m.end(), end)
                params, result = _signature(source, bracket, end) if bracket >= 0 else ([], None)
                add("function", m["function"], at, end, params=params, return_type=result, docstring=comment, exports=exported)
        elif m["class"]:
            add("class", m["class"], at, end, docstring=comment, exports=exported)
            body = source.find("{", m.end(), end)
            place = body + 1 if body >= 0 else end
            while place < end - 1:
                if skipped := blank.match(source, place, end - 1):
                    place = skipped.end()
                    continue
                inner = _METHOD.match(source, place, end)
                last = _statement_end(source, place, end - 1, bool(inner))
                if inner and source[last - 1 : last] == "}":
                    params, result = _signature(source, inner.end() - 1, last)
                    add("method", inner["name"], place, last, parent=m["class"], params=params, return_type=result, docstring=_comment_before(source, place), exports=exported)
                place = max(place + 1, last)
        elif m["interface"] or m["alias"]:
            add("type", m["interface"] or m["alias"], at, end, docstring=comment, exports=exported)
        else:
            add("constant", m["constant"], at, end, docstring=comment, exports=exported)
        at = max(at + 1, end)
    return out


def parse(source: str, language: str | None) -> list[tuple]:
    """The declarations of one source text; none for languages that are not parsed."""
    if language == "python":
        return parse_python(source)
    return parse_script(source, language) if language in V.PARSED_LANGUAGES else []


def parsed(files: DataFrame) -> DataFrame:
    """A row per declaration for (path, language, content): path, number within the file, and the fields of a node."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, language, content in zip(frame["path"], frame["language"], frame["content"]):
                text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or ""
                rows += [(path, n, *item) for n, item in enumerate(parse(text, language))]
            yield pd.DataFrame(rows, columns=["path", "number", *FIELDS])

    kept = files.where(F.col("language").isin(*V.PARSED_LANGUAGES)).select("path", "language", "content")
    return kept.mapInPandas(run, "path string, number int, type string, name string, line_start int, line_end int, language string, parent string, params array<string>, return_type string, docstring string, exports boolean, text string")
