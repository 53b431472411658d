"""Search by symbol name, type, parent and language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark import values as V


def matches(name: str, mode: str = "fuzzy", literal: bool = False) -> Column:
    """Whether the column ``name`` matches: exactly in case, or in any case as a prefix or anywhere, where ``_`` and
    ``%`` are wildcards unless ``literal``."""
    if mode == "exact":
        return F.col("name") == name
    like = name.replace("\\", "\\\\")
    if literal:
        like = like.replace("_", "\\_").replace("%", "\\%")
    return F.col("name").ilike(like + "%" if mode == "prefix" else f"%{like}%")


def search(corpus: DataFrame, name: str | None = None, kind: str | None = None, parent: str | None = None, language: str | None = None, mode: str = "fuzzy", limit: int = 10, literal: bool = False) -> DataFrame:
    """(chunk_id, score, rank), by name and line; filters that are empty or null do not count."""
    tests = [matches(name, mode, literal)] if name else []
    tests += [F.col(c) == v for c, v in (("type", kind), ("parent", parent), ("language", language)) if v]
    kept = corpus.where(reduce(lambda a, b: a & b, tests)) if tests else corpus
    first = kept.select("id", "name", "line_start").orderBy(F.col("name").asc_nulls_first(), "line_start", "id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.col("name").asc_nulls_first(), "line_start", "id"))
    return first.select(F.col("id").alias("chunk_id"), F.lit(V.SYMBOL_SCORES[mode]).alias("score"), rank.alias("rank"))


def batch(corpus: DataFrame, names: DataFrame, limit: int, language: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for (query_id, position, name): every name is searched anywhere in any case,
    ``limit`` rows a name, and a chunk stays where it came first.  ``names`` holds a bounded batch."""
    rows = corpus.where(F.col("name").isNotNull() & ((F.col("language") == language) if language else F.lit(True))).select("id", "name", "line_start")
    wanted = F.broadcast(names.select("query_id", "position", F.col("name").alias("wanted")))
    hits = rows.join(wanted, F.expr("name ilike concat('%', wanted, '%')"))
    nth = F.row_number().over(Window.partitionBy("query_id", "position").orderBy("name", "line_start", "id"))
    limited = hits.withColumn("nth", nth).where(F.col("nth") <= limit)
    first = limited.groupBy("query_id", "id").agg(F.min(F.struct("position", "nth")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return first.select("query_id", F.col("id").alias("chunk_id"), F.lit(V.SYMBOL_SCORES["fuzzy"]).alias("score"), rank.alias("rank"))
