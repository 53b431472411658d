"""Exact nearest vectors for a bounded batch of query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.functions.text import distance

BATCH_ROWS = 1000


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], limit: int) -> DataFrame:
    """(query_id, chunk_id, distance, score, rank) of the ``limit`` nearest of (chunk_id, vector) by Euclidean
    distance; score 1 / (1 + distance).  More queries than ``BATCH_ROWS`` must come in several batches."""
    if len(queries) > BATCH_ROWS:
        raise ValueError(f"a batch holds at most {BATCH_ROWS} query vectors")
    batch = F.broadcast(vectors.sparkSession.createDataFrame([(q, list(map(float, v))) for q, v in queries], "query_id long, wanted array<double>"))
    far = vectors.join(batch, F.size("vector") == F.size("wanted")).select("query_id", "chunk_id", distance("vector", "wanted").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "chunk_id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "chunk_id", "distance", (1 / (1 + F.col("distance"))).alias("score"), "rank")
