"""Search by path: globs and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.functions.text import bare_name, folders, glob_pattern


def by_glob(files: DataFrame, chunks: DataFrame, glob: str, limit: int) -> DataFrame:
    """(chunk_id, score, rank): the chunks of the matching files, file by file in the order of ids, score 1."""
    matching = files.where(F.col("path").rlike(glob_pattern(glob))).select(F.col("id").alias("file_id"))
    order = ["file_id", "line_start", "id"]
    first = chunks.select("id", "file_id", "line_start").join(matching, "file_id").orderBy(*order).limit(limit)
    return first.select(F.col("id").alias("chunk_id"), F.lit(1.0).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def path_score(path, term):
    """1.0 for a folder of that name, 0.9 for the bare file name, 0.7 anywhere in the path, else 0."""
    lower, steps = F.lower(path), V.PATH_SCORES
    return F.when(F.array_contains(folders(lower), term), steps["directory"]).when(bare_name(lower) == term, steps["filename"]).when(F.contains(lower, term), steps["partial"]).otherwise(0.0)


def by_keywords(files: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) for (query_id, terms), a bounded batch with lower-case terms.

    A file's score is that of its best term; files take turns with their chunks, the best file first in each round.
    """
    batch = F.broadcast(queries)
    scored = files.select(F.col("id").alias("file_id"), "path").join(batch).select("query_id", "file_id", F.coalesce(F.array_max(F.transform("terms", lambda t: path_score(F.col("path"), t))), F.lit(0.0)).alias("score"))
    rows = chunks.select("id", "file_id", "line_start").join(scored.where("score > 0"), "file_id")
    turn = F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy("line_start", "id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", F.desc("score"), "file_id"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")
