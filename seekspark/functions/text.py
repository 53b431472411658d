"""Column expressions: folding and tokens, snippets, size estimates, hashes, globs and path parts.

All stay inside the JVM.  Null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark import values as V

ACCENTED = "àáâãäåāăąçćčďèéêëēęěğìíîïīłñńňòóôõöøōőřśšşťùúûüūůűýÿžźż"
UNACCENTED = "aaaaaaaaacccdeeeeeeegiiiiilnnnoooooooorssstuuuuuuuyyzzz"
NOT_TOKEN = r"[^\p{L}\p{N}]+"
BLANKS = r"[ \t\r\n\f\x0b]+"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(column(c)), ACCENTED, UNACCENTED)


def tokens(c) -> Column:
    """Runs of letters and digits, folded; none for null."""
    return F.filter(F.split(fold(F.coalesce(column(c), F.lit(""))), NOT_TOKEN), lambda t: t != "")


def words(c) -> Column:
    """Runs of other than blank characters."""
    return F.filter(F.split(column(c), BLANKS), lambda w: w != "")


def token_estimate(c) -> Column:
    """ceil(1.3 x words), in double arithmetic."""
    return F.ceil(F.size(words(c)) * F.lit(V.TOKENS_PER_WORD).cast("double")).cast("long")


def one_line(c) -> Column:
    return F.trim(F.regexp_replace(column(c), BLANKS, " "))


def snippet(c, length: int = V.SNIPPET_CHARS) -> Column:
    """The text on one line, cut to ``length`` characters with three dots behind a cut."""
    line = one_line(c)
    return F.when(F.length(line) <= length, line).otherwise(F.concat(F.substring(line, 1, length), F.lit("...")))


def short_hash(c) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(column(c), 256), 1, 16)


def chunk_id(path, first, last) -> Column:
    return short_hash(F.concat_ws(":", column(path), column(first).cast("string"), column(last).cast("string")))


def sanitised(c) -> Column:
    """A full-text query reduced to letters, digits, underscores and one trailing star a word."""
    parts = F.split(F.regexp_replace(column(c), "[^A-Za-z0-9_*]+", " "), " +")
    plain = F.transform(parts, lambda t: F.when(F.replace(t, F.lit("*"), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.replace(t, F.lit("*"), F.lit("")), F.when(t.endswith("*"), F.lit("*")).otherwise(F.lit("")))))
    return F.array_join(F.filter(plain, lambda t: t != ""), " ")


def file_name(c) -> Column:
    return F.element_at(F.split(column(c), "/"), -1)


def bare_name(c) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(c), r"\.[^.]+$", "")


def folders(c) -> Column:
    parts = F.split(column(c), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def extension(c) -> Column:
    """The last extension with its dot in lower case; a dotfile without another dot is its own extension."""
    name = file_name(c)
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)))


def language_of(c) -> Column:
    """The language a path's extension stands for, or null."""
    known = F.create_map(*[F.lit(x) for pair in V.LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension(c))


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ``**`` crosses folders and takes a slash behind it along, ``*`` and
    ``?`` stay within a folder."""
    wild = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + re.sub(r"\*\*/?|\*|\?|[^*?]+", lambda m: wild.get(m.group()) or re.escape(m.group()), glob) + "$"


def ignore_pattern(rules: list[str]) -> str:
    """Ignore rules without slash as one regular expression over relative paths: a rule hides a file or folder of
    that name at any depth, with all below."""
    names = "|".join(re.escape(r).replace(r"\*", "[^/]*") for r in rules)
    return f"(^|/)({names})(/|$)"


def unit_vector(c) -> Column:
    """The vector at length one; the zero vector as it is."""
    norm = F.sqrt(F.aggregate(column(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(column(c), lambda x: x.cast("double"))).otherwise(F.transform(column(c), lambda x: x.cast("double") / norm))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """The cosine of two vectors, 0 where either is zero."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def distance(a, b) -> Column:
    """The Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(column(a), column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def readable_bytes(c) -> Column:
    size = column(c).cast("double")
    return F.when(size < 1024, F.format_string("%d B", column(c).cast("long"))).when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))
