"""Files of a source tree as a table, ignored ones left out."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.functions.text import language_of


def read_rules(path: str) -> list[str]:
    """The rules of an ignore file: trimmed lines that are neither blank nor comments; none if it cannot be read."""
    try:
        with open(path, encoding="utf-8") as lines:
            return [x for x in map(str.strip, lines) if x and not x.startswith("#")]
    except OSError:
        return []


def rule_pattern(rule: str) -> tuple[str, bool]:
    """(regular expression over relative paths, whether it hides) of one rule in the usual ignore syntax: ``!`` shows
    again, a slash before the end anchors to the root, a slash at the end means folders only."""
    hides = not rule.startswith("!")
    rule = rule.lstrip("!") if not hides else rule
    folder = rule.endswith("/")
    body = rule.strip("/")
    anchored = "/" in rule.rstrip("/")
    wild = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    inner = re.sub(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?/]+|/", lambda m: wild.get(m.group()) or re.escape(m.group()), body)
    return ("^" if anchored else "(?:^|/)") + inner + ("/" if folder else "(?:/|$)"), hides


def kept(path, rules: list[str]):
    """A column that says whether a relative path is shown; of the rules that match, the last decides."""
    shown = F.lit(True)
    for rule in rules:
        pattern, hides = rule_pattern(rule)
        shown = F.when(path.rlike(pattern), F.lit(not hides)).otherwise(shown)
    return shown


def tree_rules(root: str, extra: list[str] | None = None) -> list[str]:
    """Built-in rules, then those of the root's ignore files, then more."""
    return [*V.IGNORED, *read_rules(os.path.join(root, ".gitignore")), *read_rules(os.path.join(root, ".ctxignore")), *(extra or [])]


def listed(root: str, extra: list[str] | None = None, follow: bool = True) -> list[tuple[str, int, float]]:
    """(relative path, size, time) of the files of a local tree with a known language, in the order of paths.  Ignored
    folders are not entered, unreadable ones skipped; links are followed unless told otherwise."""
    rules = [(re.compile(p), hides) for p, hides in map(rule_pattern, tree_rules(root, extra))]

    def hidden(path: str) -> bool:
        out = False
        for pattern, hides in rules:
            if pattern.search(path):
                out = hides
        return out

    found, seen = [], set()
    for folder, folders, names in os.walk(root, followlinks=follow, onerror=lambda _: None):
        real = os.path.realpath(folder)
        inside = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if inside == "." else inside + "/"
        if real in seen:
            folders[:] = []
            continue
        seen.add(real)
        folders[:] = sorted(d for d in folders if not hidden(prefix + d + "/"))
        for name in names:
            path, full = prefix + name, os.path.join(folder, name)
            if hidden(path) or os.path.islink(full) and not follow or not language(path):
                continue
            try:
                state = os.stat(full)
            except OSError:
                continue
            found.append((path, state.st_size, state.st_mtime))
    return sorted(found)


def language(path: str) -> str | None:
    """The language a path's extension stands for; a dotfile without another dot is its own extension."""
    name = path.rsplit("/", 1)[-1]
    if re.fullmatch(r"\.[^.]*", name):
        return V.LANGUAGES.get(name)
    return V.LANGUAGES.get(os.path.splitext(name)[1].lower())


def discovered(spark: SparkSession, root: str, extra: list[str] | None = None) -> DataFrame:
    """(path, language, hash, size, modified, content) of a tree any Spark file system can read: one distributed scan,
    ignored and unknown files left out before their content is hashed."""
    base = root.rstrip("/") + "/"
    rules = tree_rules(root, extra) if os.path.isdir(root) else [*V.IGNORED, *(extra or [])]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    relative = F.substring(bare, F.lit(len(re.sub("^[a-z]+:/*", "/", os.path.abspath(base) if os.path.isdir(root) else base).rstrip("/")) + 2), F.lit(1 << 20))
    rows = read.withColumn("path", relative).where(kept(F.col("path"), rules)).withColumn("language", language_of("path")).where("language is not null")
    return rows.select("path", "language", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
