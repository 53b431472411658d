"""Breadth-first traces through the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.shared import cut


def trace(edges: DataFrame, starts: DataFrame, direction: str, depth: int) -> DataFrame:
    """(start, chunk_id, depth, score) of every chunk within ``depth`` steps of (start,), the starts left out.

    ``edges`` is (src, dst).  Every level is one join and one anti-join with what was seen, cut by a checkpoint; the
    frontier is made distinct before it grows, so a target of many edges is one row a start.  A step's score is
    1.0 - 0.2 x (steps - 1), without a floor.
    """
    if direction not in ("imports", "importedBy"):
        raise ValueError("direction is imports or importedBy")
    here, there = ("src", "dst") if direction == "imports" else ("dst", "src")
    links = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    score = F.lit(V.DEPTH_START) - F.lit(V.DEPTH_STEP) * (F.col("depth") - 1)
    return seen.where("depth > 0").select("start", F.col("node").alias("chunk_id"), "depth", score.alias("score"))


def neighbours(edges: DataFrame, chunk: int, direction: str = "imports") -> DataFrame:
    """The direct targets, or sources, of one chunk."""
    here, there = ("src", "dst") if direction == "imports" else ("dst", "src")
    return edges.where(F.col(here) == chunk).select(F.col(there).alias("chunk_id"), "type").distinct()
