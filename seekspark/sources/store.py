"""The stored index: immutable snapshots of Parquet tables, a manifest and a pointer to the current one.

A change writes the tables it touches into a new folder, beside a manifest that says in which folder each table now
lies, and then moves the pointer, which takes the place of transactions: a failure before that leaves the old snapshot
in use, and tables that did not change are not copied.  ``vacuum`` removes what the current manifest does not name.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.errors import StoreError
from seekspark.functions.embedding import Embedder, embedded, prepared
from seekspark.operators import changes, chunking, fulltext
from seekspark.shared import cut
from seekspark.sources import discovery, parsing

VERSION = 1
SCHEMAS = {
    "files": "id long, path string, language string, hash string, size long, last_indexed timestamp",
    "chunks": "id long, file_id long, line_start int, line_end int, type string, name string, parent string, text string, imports array<string>, exports boolean, hash string",
    "dependencies": "src long, dst long, type string",
    "chunk_vectors": "chunk_id long, vector array<float>",
    "postings": "key long, field int, token string, position int",
    "lengths": "key long, length long",
}


class Index:
    """One index in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    @property
    def exists(self) -> bool:
        return os.path.exists(self._path("CURRENT"))

    @property
    def version(self) -> int:
        try:
            with open(self._path("CURRENT")) as pointer:
                return int(pointer.read())
        except (OSError, ValueError) as cause:
            raise StoreError(f"no index in {self.folder}", "NOT_INITIALIZED") from cause

    def manifest(self) -> dict:
        try:
            with open(self._path(f"v={self.version}", "manifest.json")) as lines:
                return json.load(lines)
        except (OSError, ValueError) as cause:
            raise StoreError("the manifest cannot be read", "DB_CORRUPTED") from cause

    def put(self, **entries) -> None:
        """Set entries of the manifest."""
        said = self.manifest() | entries
        self._write_json(self._path(f"v={self.version}", "manifest.json"), said)

    def _write_json(self, path: str, said: dict) -> None:
        with open(path + ".new", "w") as out:
            json.dump(said, out)
        os.replace(path + ".new", path)

    def table(self, name: str) -> DataFrame:
        version = self.manifest().get("tables", {}).get(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(f"v={version}", name))

    @classmethod
    def create(cls, spark: SparkSession, folder: str, dimensions: int, embedder: str = "local") -> Index:
        """Open the index in a folder, made if there is none; its vectors must have the dimensions given."""
        index = cls(spark, folder)
        if index.exists:
            index.check(dimensions)
            return index
        os.makedirs(index._path("v=0"), exist_ok=True)
        index._write_json(index._path("v=0", "manifest.json"), {"schema_version": VERSION, "dimensions": dimensions, "embedder": embedder})
        index._point(0)
        return index

    def check(self, dimensions: int | None) -> None:
        """Refuse manifests that are broken, of a later version, or for vectors of other dimensions."""
        said = self.manifest()
        stored = said.get("dimensions")
        if not isinstance(stored, int) or stored <= 0:
            raise StoreError("the manifest has no valid dimensions", "DB_CORRUPTED")
        if said.get("schema_version", 0) > VERSION:
            raise StoreError("the index was written by a later version", "DB_CORRUPTED")
        if dimensions is not None and dimensions != stored:
            raise StoreError(f"the index holds vectors of {stored} dimensions, not {dimensions}", "CONFIG_INVALID")

    def _point(self, version: int) -> None:
        with open(self._path("CURRENT.new"), "w") as out:
            out.write(str(version))
        os.replace(self._path("CURRENT.new"), self._path("CURRENT"))

    def commit(self, **tables: DataFrame) -> None:
        """A new snapshot with the tables given and all others where they are; then the pointer moves."""
        said, new = self.manifest(), self.version + 1
        place = self._path(f"v={new}")
        shutil.rmtree(place, ignore_errors=True)
        os.makedirs(place)
        try:
            for name, rows in tables.items():
                rows.write.parquet(os.path.join(place, name))
            said["tables"] = said.get("tables", {}) | dict.fromkeys(tables, new)
            self._write_json(os.path.join(place, "manifest.json"), said)
        except Exception as cause:
            shutil.rmtree(place, ignore_errors=True)
            raise StoreError(f"the snapshot could not be written: {cause}", "DB_WRITE_FAILED") from cause
        self._point(new)

    def vacuum(self) -> None:
        """Remove tables and manifests that no longer count."""
        current, used = self.version, self.manifest().get("tables", {})
        for folder in os.listdir(self.folder):
            if not folder.startswith("v="):
                continue
            kept = {name for name, version in used.items() if folder == f"v={version}"}
            if folder == f"v={current}":
                kept.add("manifest.json")
            for name in set(os.listdir(self._path(folder))) - kept:
                path = self._path(folder, name)
                shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
            if not kept:
                os.rmdir(self._path(folder))

    def corpus(self) -> DataFrame:
        owners = self.table("files").select(F.col("id").alias("file_id"), "path", "language")
        return self.table("chunks").join(owners, "file_id")

    def file(self, path: str) -> DataFrame:
        return self.table("files").where(F.col("path") == path)

    def chunks_of(self, file_id: int) -> DataFrame:
        return self.table("chunks").where(F.col("file_id") == file_id).orderBy("line_start", "id")

    def chunks_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.corpus().join(ids.select(F.col("chunk_id").alias("id")).distinct(), "id")

    def status(self) -> dict:
        """Counts, languages from the most frequent on, and the last time of indexing."""
        files = self.table("files")
        languages = {r.language: r.n for r in files.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").collect()}
        return {
            "files": sum(languages.values()),
            "chunks": self.table("chunks").count(),
            "vectors": self.table("chunk_vectors").count(),
            "languages": languages,
            "last_indexed": files.agg(F.max("last_indexed")).first()[0],
            **{k: self.manifest().get(k) for k in ("embedder", "dimensions")},
        }

    def update(self, found: DataFrame, partial: DataFrame | None = None) -> dict[str, int]:
        """Bring the index to the files ``found`` (path, language, hash, size, content).

        Only changed files are parsed; files that are gone go with their chunks and vectors.  With ``partial``, the
        paths a change feed names, only those count as compared.  Returns the number of files by status.
        """
        stored = self.table("files")
        seen = found if partial is None else found.join(partial.select("path").distinct(), "path", "left_semi")
        against = stored if partial is None else stored.join(partial.select("path").distinct(), "path", "left_semi")
        status = changes.compared(seen, against)
        changed = seen.join(status.where("status in ('added', 'modified')").select("path"), "path", "left_semi")
        counts = {r.status: r.n for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = status.where("status in ('modified', 'deleted')").select("path")
        _, chunks, vectors = changes.without_files(stored, self.table("chunks"), self.table("chunk_vectors"), touched)
        gone = status.where("status = 'deleted'").select("path")
        kept = stored.join(gone, "path", "left_anti")
        files = changes.upserted(kept.select("id", "path", "language", "hash", "size"), changed.select("path", "language", "hash", "size"))
        times = kept.select("path", "last_indexed").join(changed.select("path"), "path", "left_anti")
        files = files.join(times, "path", "left").withColumn("last_indexed", F.coalesce("last_indexed", F.current_timestamp())).select("id", "path", "language", "hash", "size", "last_indexed")
        ids = files.select("path", F.col("id").alias("file_id"))
        nodes = parsing.parsed(changed).join(ids, "path").withColumn("node_id", F.col("number").cast("long"))
        fresh = chunking.chunked(nodes).withColumn("order", F.concat_ws(":", F.lpad("file_id", 12, "0"), F.lpad("line_start", 9, "0"), "id"))
        top = chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        numbered = changes.dense_numbers(fresh.drop("id"), "order").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("number"))
        columns = ["id", "file_id", "line_start", "line_end", "type", "name", "parent", "text", "imports", "exports", "hash"]
        numbered = cut(numbered.select(columns))
        every = chunks.select(columns).unionByName(numbered)
        self.commit(files=files, chunks=every, chunk_vectors=vectors, **self._fulltext(chunks, numbered))
        return {s: counts.get(s, 0) for s in ("added", "modified", "deleted", "unchanged")}

    def _fulltext(self, kept: DataFrame, fresh: DataFrame) -> dict[str, DataFrame]:
        """Postings and lengths: those of the chunks that stay, and new ones for the fresh chunks."""
        positions, lengths = fulltext.postings(fresh, "id", ["name", "text", "parent"])
        stay = kept.select(F.col("id").alias("key"))
        every = self.table("postings").join(stay, "key", "left_semi").select("key", "field", "token", "position").unionByName(positions.select("key", "field", "token", "position"))
        return {"postings": every.repartition("token").sortWithinPartitions("token"), "lengths": self.table("lengths").join(stay, "key", "left_semi").unionByName(lengths)}

    def embed(self, model: Embedder, slices: int = 1) -> int:
        """Vectors for all chunks that lack one, also those a failed run left; returns how many were missing.

        Each slice of the chunks is committed by itself, so that a failure loses one slice at most.
        """
        total = 0
        for part in range(slices):
            stored = self.table("chunk_vectors")
            missing = changes.missing_vectors(self.corpus(), stored).where(F.pmod(F.xxhash64("id"), F.lit(slices)) == part)
            n = missing.count()
            if n:
                ready = missing.select("id", prepared("path", "parent", "text").alias("text"))
                self.commit(chunk_vectors=stored.unionByName(embedded(ready, "id", "text", model)))
                self.put(embedder=model.name)
            total += n
        return total


def indexed(spark: SparkSession, root: str, folder: str, model: Embedder, report: Callable[[str], None] = lambda _: None, embed: bool = True) -> dict:
    """Index a source tree: discover, compare, parse, chunk, store, embed."""
    began = time.time()
    index = Index.create(spark, folder, model.dimensions, model.name)
    found = discovery.discovered(spark, root)
    counts = index.update(found)
    report(f"{counts['added']} added, {counts['modified']} modified, {counts['deleted']} deleted, {counts['unchanged']} unchanged")
    vectors = index.embed(model) if embed else 0
    return counts | {"embedded": vectors, "seconds": round(time.time() - began, 3)}
