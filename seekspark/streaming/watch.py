"""A stream of file changes, gathered into batches by a debounce and handed to the index one after another."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.functions.text import file_name

LOG = logging.getLogger("seekspark.watch")


def watched(path: Column, ignored: list[str] | None = None) -> Column:
    """Whether changes of a path count: a known extension, and no ignored folder or name on the way."""
    endings = "|".join(e.replace(".", "[.]") for e in V.LANGUAGES)
    known = F.lower(file_name(path)).rlike(f"^.+({endings})$")
    away = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, [*V.UNWATCHED_FOLDERS, *(ignored or [])])))
    return known & ~away


def events(spark: SparkSession, folder: str, schema: str = "path string, type string, ts timestamp_ntz, received_at timestamp_ntz") -> DataFrame:
    """A stream of change events from Parquet files that arrive in a folder."""
    read = spark.readStream.schema(schema).parquet(folder)
    return read.where("path is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("repo", F.split("path", "/")[0])


def debounced(stream: DataFrame, gap: str = f"{V.DEBOUNCE_MS} milliseconds", lateness: str = "1 day") -> DataFrame:
    """(repo, session, changes): the changes of a repository until nothing happens for ``gap``; of each path the last
    event counts, paths in the order in which they first came.  Events later than ``lateness`` are dropped."""
    grouped = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "repo")
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct("ts", "path", "type"))).alias("events"))
    paths = F.array_distinct(F.transform("events", lambda e: e["path"]))
    last = F.transform(paths, lambda p: F.struct(p.alias("path"), F.element_at(F.filter("events", lambda e: e["path"] == p), -1)["type"].alias("type")))
    return listed.select("repo", F.col("session_window.start").alias("session"), last.alias("changes"))


def follow(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Hand every batch of debounced changes to ``handle``, strictly one after another; a failure is logged and the
    stream goes on.  ``once`` ends when all files present have been read."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("repo", "session", F.explode("changes").alias("c")).select("repo", "session", "c.path", "c.type")
        try:
            handle(rows, number)
        except Exception:
            LOG.exception("batch %s failed", number)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drained(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """All closed sessions of the events in one table, read as a stream: (repo, session, path, type)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    place = f"{base.rstrip('/')}/watch-{uuid.uuid4().hex}"
    stream = debounced(events(spark, path if os.path.isdir(path) else path.rpartition("/")[0] + "/file_changes.parque[t]"), gap)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").option("path", f"{place}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("repo string, session timestamp, changes array<struct<path:string,type:string>>").parquet(f"{place}/rows")
    return rows.select("repo", "session", F.explode("changes").alias("c")).select("repo", "session", "c.path", "c.type")
