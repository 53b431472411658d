"""Problem 5: tell generated, minified and vendored files and data blobs from hand-written source.

Every chunk is lexed into comments, strings, numbers, names and signs, and emitted again in a canonical layout: a line
for every statement and brace, indented by depth, one blank between words.  The lines there are are compared with
those, and what the tokens are made of is counted.  The counts of the distinct chunks of a file are summed before the
verdict:

* extreme expansion - the canonical layout has many times the lines of the original - marks minified code;
* perfect uniformity - nearly all lines as the canonical layout has them, and nearly all pieces of the file of one and
  the same shape once names and numbers are masked, without any comment - marks generated code, as do the words
  generators leave in the leading comment;
* dominance of literals - next to nothing but dense strings and numbers in a code file - marks data blobs;
* a leading banner with a library's name, version and licence, or a folder for third-party code, marks vendored files,
  and names that only tools give mark lock files, bundles and generated files; these alone judge files without chunks.

Defined results: rows repeated under one id count once; null texts and paths count as empty; chunks without a file
give no row; a file without chunks is judged by its path.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPANSION, LITERALS, UNIFORM = 8.0, 0.9, 0.8
_LEX = re.compile(
    r"""(?P<c>/\*.*?(?:\*/|\Z)|(?:(?<![:\w])//|(?<![^\s])\#(?=[\s!#-]|\w+[^\w\n]))[^\n]*)|(?P<s>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)""",
    re.S,
)
_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"\b\d[\d._]*\b|\b0x[0-9a-fA-F]+\b")
_HEAD = re.compile(r"""(?:\s*(?:\#!?[^\n]*(?:\n|\Z)|//[^\n]*(?:\n|\Z)|/\*.*?\*/|<!--.*?-->|--[^\n]*(?:\n|\Z)|["']use strict["'];?))+""", re.S)
# Words that generators leave at the head of their output.
_GENERATED = re.compile(
    r"(?i)(?:\bcode generated (?:by|from|using)\b|\b(?:this|the) (?:file|code|module|class) (?:is|was|has been) (?:auto\w*[- ]?)?generated\b|\bauto-?(?:matically )?[- ]?generated(?: (?:file|code|by|from|using|with|on)\b|\s*[:.-]|\s*$)|<auto-?generated|@(?:auto)?generated\b|^\W*generated (?:from|by|with|using|on|at|automatically)\b|\bmachine[- ]generated\b|\bdo not (?:edit|modify|change)(?: this file| it)?(?: by hand| manually| directly)?\s*(?:[.!,;:*-]|$)|\bdo not (?:edit|modify|change) (?:this file|by hand|manually|directly)\b|\bchanges (?:to this file )?will be (?:lost|overwritten)\b|\bregenerate (?:with|by|using)\b|^\W*autogenerated\b|\bgenerated file\b[^.\n]{0,20}\b(?:do not|don't)\b)",
    re.M,
)
_BANNER_NAME = re.compile(r"(?im)^[\W_]*(?:@(?:license|preserve)\s+)?[\w@/.-]{2,40}(?: [\w.-]{1,20}){0,2},?\s+v?(?:ersion )?\d+\.\d+(?:\.\d+)?\b")
_BANNER_TERMS = re.compile(r"(?i)\b(?:licen[cs]ed?|mit|bsd|apache|isc|mpl|gpl|lgpl|contributors|copyright|unlicense|public domain)\b|\(c\)|©")
CODE_ENDINGS = "js jsx mjs cjs ts tsx mts cts py pyi go rs java kt scala rb php c h cc cpp cxx hpp cs swift lua pl dart sh vue svelte".split()
_VENDOR_FOLDERS = "vendor _vendor vendored _vendored third_party third-party thirdparty 3rdparty 3rd_party 3rd-party node_modules bower_components jspm_packages external externals extern site-packages dist-packages pods carthage web_modules".split()
_GENERATED_FOLDERS = "generated __generated__ gen autogen auto_generated generated-sources generated_sources __pycache__".split()
_GENERATED_NAMES = r"(?:_pb2?\d*(?:_grpc)?\.\w+|[._]pb\d?\.\w+(?:\.\w+)?|\.(?:generated|g|gen|freezed|designer|min|bundle|chunk)\.\w+|[._-]generated\.\w+|^zz_generated\S*|\.min\.(?:\w+\.)?\w+|\.map|\.snap|\.[0-9a-f]{8,}\.(?:js|css|mjs|cjs|ts|tsx|jsx))$"
_LOCKS = r"^(?:package-lock\.json|npm-shrinkwrap\.json|[\w.-]+-lock\.(?:json|ya?ml|toml)|[\w.-]+\.lock(?:\.\w+)?|[\w.-]+\.lockb?|go\.sum|podfile\.lock|packages\.lock\.json|project\.assets\.json)$"


_BREAK = re.compile(r"(?<=[;{}])[ \t]*(?=[^\s;,)\]])|\n")


def reemitted(code: str) -> list[tuple[int, str]]:
    """(depth, line) of the canonical layout of code whose comments and strings are taken out; where a file has no
    braces its own indentation, in steps of the least one, gives the depth."""
    pieces = [p for p in _BREAK.split(code) if not p.isspace() and p]
    if "{" not in code:
        indents = [len(p) - len(p.lstrip()) for p in pieces]
        step = min((i for i in indents if i), default=1)
        return [(i // step, " ".join(p.split())) for i, p in zip(indents, pieces)]
    out, depth = [], 0
    for p in pieces:
        line = " ".join(p.split())
        if line[0] in "})]":
            depth = max(0, depth - 1)
        out.append((depth, line))
        depth = max(0, depth + line.count("{") + line.count("(") + line.count("[") - line.count("}") - line.count(")") - line.count("]") + (line[0] in "})]"))
    return out


def measured(text: str) -> tuple[int, int, int, int, int, int, int, bool, bool]:
    """Lines with code, lines of the canonical layout, lines that are as there, dense literal characters, characters of
    names and prose, comments, longest line, and whether the head says generated or vendored."""
    comments, dense, prose, parts, at = 0, 0, 0, [], 0
    for m in _LEX.finditer(text):
        parts.append(text[at : m.start()])
        at = m.end()
        if m.lastgroup == "c":
            comments += 1
            continue
        value = m.group()
        parts.append('"')
        if value.count(" ") + value.count("\n") > len(value) // 20:
            prose += len(value)
        else:
            dense += len(value)
    parts.append(text[at:])
    code = "".join(parts)
    lines = [line for line in code.split("\n") if line.strip()]
    canonical = reemitted(code)
    step = min((n for n in (len(x) - len(x.lstrip()) for x in lines) if n), default=1)
    uniform = sum(x == " " * (step * depth) + line for x, (depth, line) in zip(lines, canonical)) if len(lines) == len(canonical) else 0
    names = sum(map(len, _NAME.findall(code)))
    dense += sum(map(len, _NUMBER.findall(code)))
    head = _HEAD.match(text)
    head = head.group() if head else ""
    return (
        len(lines),
        len(canonical),
        uniform,
        dense,
        names + prose,
        comments,
        max(map(len, lines), default=0),
        bool(_GENERATED.search(head)),
        bool(_BANNER_NAME.search(head[:400]) and _BANNER_TERMS.search(head)),
    )


def shape(text: str) -> int:
    """A hash of the text with names, numbers and strings masked, equal for pieces a template made."""
    masked = re.sub(r"[^\W\d]\w*", "n", re.sub(r"\d[\w.]*", "0", _LEX.sub(lambda m: "c" if m.lastgroup == "c" else "s", text)))
    return xxhash.xxh64_intdigest(" ".join(masked.split())) - (1 << 63)


def _measure(frames):
    for frame in frames:
        rows = []
        for key, file, line, kind, text in zip(*(frame[c] for c in ("id", "file_id", "line", "type", "text"))):
            rows.append((key, file, line, shape(text) if kind in ("function", "method") else None, kind in ("function", "method"), *measured(text)))
        out = pd.DataFrame(rows, columns=["id", "file_id", "line", "shape", "function", "lines", "canonical", "uniform", "dense", "words", "comments", "longest", "generated", "banner"])
        out["shape"] = pd.array([r[3] for r in rows], dtype="Int64")  # a float would not hold a hash
        yield out


def file_layout(chunks: DataFrame) -> DataFrame:
    """One row of counts for each file that has chunks."""
    narrow = chunks.where("file_id is not null").select("id", "file_id", F.coalesce("line_start", F.lit(1)).cast("long").alias("line"), "type", F.coalesce("text", F.lit("")).alias("text"))
    each = narrow.mapInPandas(
        _measure,
        "id long, file_id long, line long, shape long, function boolean, lines long, canonical long, uniform long, dense long, words long, comments long, longest long, generated boolean, banner boolean",
    ).dropDuplicates(["id"])
    shapes = each.groupBy("file_id", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("function").alias("functions"),
        *[F.sum(c).alias(c) for c in ("lines", "canonical", "uniform", "dense", "words", "comments")],
        F.max("longest").alias("longest"),
        F.max(F.struct(-F.col("line"), "generated", "banner")).alias("head"),
    )
    return shapes.groupBy("file_id").agg(
        F.max(F.when(F.col("shape").isNotNull(), F.col("n"))).alias("alike"),
        *[F.sum(c).alias(c) for c in ("functions", "lines", "canonical", "uniform", "dense", "words", "comments")],
        F.max("longest").alias("longest"),
        F.max("head").alias("head"),
    )


def judged(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, kind) of every file once; ``kind`` is null for hand-written ones.  Files are joined with counts, not texts."""
    path = F.lower(F.coalesce("path", F.lit("")))
    narrow = files.select("id", path.alias("path")).groupBy("id").agg(F.max("path").alias("path"))
    folders = F.expr("slice(split(path, '/'), 1, greatest(0, size(split(path, '/')) - 1))")
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.element_at(F.split("path", r"\."), -1)
    at = lambda listed: F.arrays_overlap(folders, F.array(*map(F.lit, listed)))
    is_code = ending.isin(CODE_ENDINGS)
    counts = narrow.join(file_layout(chunks).withColumnRenamed("file_id", "id"), "id", "left")
    kind = (
        F.when(at(_VENDOR_FOLDERS), "vendored")
        .when(name.rlike(_LOCKS), "lock")
        .when(name.rlike(_GENERATED_NAMES) | at(_GENERATED_FOLDERS), "generated")
        .when(F.col("head.generated"), "generated")
        .when(F.col("head.banner"), "vendored")
        .when(is_code & (F.col("dense") >= 300) & (F.col("dense") >= LITERALS * (F.col("dense") + F.col("words"))), "data")
        .when(is_code & (F.col("canonical") >= EXPANSION * F.greatest(F.col("lines"), F.lit(1))) & (F.col("canonical") >= 20), "minified")
        .when(is_code & (F.col("functions") >= 3) & (F.col("alike") >= UNIFORM * F.col("functions")) & (F.col("comments") == 0) & (F.col("uniform") >= UNIFORM * F.col("lines")), "generated")
    )
    return counts.select("id", kind.alias("kind"))
