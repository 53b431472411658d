"""What changed between a tree of files and the stored index, and the rows to keep, replace and drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.shared import cut


def compared(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status, hash) for (path, hash) of both sides; status is added, modified, deleted or unchanged.  Paths
    are unique on either side; the hash of deleted files is null."""
    a, b = found.select("path", "hash").alias("a"), stored.select("path", "hash").alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    status = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "deleted").when(F.col("a.hash").eqNullSafe(F.col("b.hash")), "unchanged").otherwise("modified")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status"), F.col("a.hash").alias("hash"))


def matching(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """The stored files whose path and hash are as expected."""
    return stored.join(expected.select("path", "hash"), ["path", "hash"], "left_semi")


def upserted(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """The files (id, path, language, hash, size) after an upsert by path: known paths keep their ids, new ones get
    the next free ids in the order of paths."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    ids = stored.select("path", F.col("id").alias("__id"))
    new = changed.join(ids, "path", "left")
    fresh = dense_numbers(new.where(F.col("__id").isNull()).drop("__id"), "path").join(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("number"))
    known = new.where(F.col("__id").isNotNull()).withColumn("id", F.col("__id"))
    kept = stored.join(changed.select("path"), "path", "left_anti")
    columns = ["id", "path", "language", "hash", "size"]
    return kept.select(columns).unionByName(known.select(columns)).unionByName(fresh.select(columns))


def dense_numbers(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``number`` from 1 in the order of a unique column, without a sort in one task: rows are ranged into
    partitions, numbered within, and moved up by the counts of the partitions before."""
    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    inside = ranged.withColumn("__in", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(before, "__part").withColumn("number", F.col("__before") + F.col("__in") + 1).drop("__part", "__row", "__in", "__before")


def without_files(files: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and vectors after the files of the paths in ``gone`` went, with all that belongs to them."""
    kept_files = files.join(gone.select("path"), "path", "left_anti")
    lost = files.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    lost_chunks = chunks.join(lost, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return kept_files, chunks.join(lost, "file_id", "left_anti"), vectors.join(lost_chunks, "chunk_id", "left_anti")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks that have no vector yet."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def sessions(events: DataFrame, gap_seconds: float = 0.5, key: str = "repo") -> DataFrame:
    """``events`` (key, path, type, ts) with ``session``: a new one begins when nothing happened under the key for
    longer than the gap.

    A hot key is no hot task: gaps are looked for within (key, hour), against the last event of the hours before, and
    the sessions are numbered by the sums of the hours before.
    """
    hourly = events.withColumn("__at", F.col("ts").cast("timestamp").cast("double")).withColumn("__hour", F.floor(F.col("__at") / 3600))
    earlier = Window.partitionBy(key).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    ends = hourly.groupBy(key, "__hour").agg(F.max("__at").alias("__end")).select(key, "__hour", F.max("__end").over(earlier).alias("__last"))
    order = Window.partitionBy(key, "__hour").orderBy("__at", "path", "type")
    before = F.coalesce(F.lag("__at").over(order), F.col("__last"))
    flagged = hourly.join(ends, [key, "__hour"]).withColumn("__new", F.when(before.isNull() | (F.round(F.col("__at") - before, 6) > gap_seconds), 1).otherwise(0))
    sums = flagged.groupBy(key, "__hour").agg(F.sum("__new").alias("__n")).select(key, "__hour", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = flagged.withColumn("__inside", inside).join(sums, [key, "__hour"])
    return numbered.withColumn("session", F.col("__before") + F.col("__inside")).select(*events.columns, "session")


def latest_changes(events: DataFrame, gap_seconds: float = 0.5, key: str = "repo") -> DataFrame:
    """(key, session, path, type, first_seen): of each path within a session the last event counts."""
    return sessions(events, gap_seconds, key).groupBy(key, "session", "path").agg(F.max_by("type", F.struct("ts", "type")).alias("type"), F.min("ts").alias("first_seen"))
