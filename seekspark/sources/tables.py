"""The index tables as search sees them: every key once, languages in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.shared import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "files").select("id", "repo", "path", F.lower(F.trim("language")).alias("language"), "hash", "last_indexed", "size")
    return read.dropDuplicates(["id"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "chunks").select("id", "file_id", "line_start", F.coalesce("line_end", "line_start").alias("line_end"), "type", "name", "parent", F.coalesce("text", F.lit("")).alias("text"), "exports")
    return read.dropDuplicates(["id"])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its file's path and language."""
    owners = files(spark, sf_dir).select(F.col("id").alias("file_id"), "path", "language")
    return chunks(spark, sf_dir).join(owners, "file_id").select("id", "file_id", "path", "language", "line_start", "line_end", "type", "name", "parent", "text", "exports")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges once each, without self edges, their type in one spelling."""
    read = table(spark, sf_dir, "dependencies").where("source_chunk_id <> target_chunk_id")
    return read.select(F.col("source_chunk_id").alias("src"), F.col("target_chunk_id").alias("dst"), F.lower(F.trim("type")).alias("type")).distinct()


def usable_vectors(spark: SparkSession, sf_dir: str, dimensions: int = 384) -> DataFrame:
    """(chunk_id, vector) of the last usable embedding of each chunk."""
    read = table(spark, sf_dir, "embedding_results").where(F.size("vector") == dimensions)
    whole = read.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    return whole.groupBy("chunk_id").agg(F.max(F.struct("embedded_at", "vector")).alias("v")).select("chunk_id", "v.vector")
