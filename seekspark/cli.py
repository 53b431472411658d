"""The command line: init, query, ask, watch, status, config, update, symbols, deps, chunk, auth."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seekspark import settings as X
from seekspark import values as V
from seekspark.errors import SearchError, SeekError, exit_code
from seekspark.functions import http
from seekspark.functions.embedding import embedder
from seekspark.operators import graph, symbols
from seekspark.plans import hybrid, steering
from seekspark.plans import understanding as U
from seekspark.sources import discovery, store
from seekspark.streaming import watch

LOG = logging.getLogger("seekspark")
VERSION = "0.2.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("seekspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Project:
    """An indexed source tree."""

    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark, self.root = spark, os.path.abspath(root)
        self.settings = X.prepare(self.root) if create else X.Settings(self.root)
        said = self.settings.read()["embedder"]
        self.embedder = embedder(said["provider"], said["dimensions"], os.environ.get(f"CTX_{said['provider'].upper()}_KEY", ""), http.post)
        self.folder = os.path.join(self.root, X.FOLDER, "index")

    @property
    def index(self) -> store.Index:
        index = store.Index(self.spark, self.folder)
        index.check(self.embedder.dimensions)
        return index

    def init(self) -> dict:
        return store.indexed(self.spark, self.root, self.folder, self.embedder, LOG.info)

    def search(self, query: str, limit: int, asked: list[str] | None = None, language: str | None = None, plan: list[dict] | None = None) -> list:
        index = self.index
        options = {"language": language, "stored": index.table("chunk_vectors"), "embed": lambda t: self.embedder.embed([t], query=True)[0], "postings": (index.table("postings"), index.table("lengths"))}
        try:
            found = hybrid.search(index.corpus(), index.table("files"), {0: query}, limit, asked, {0: plan} if plan else None, **options)
            return hybrid.output(found).orderBy("place").collect()
        except SeekError:
            raise
        except Exception as cause:
            raise SearchError(f"the search failed: {cause}", "SEARCH_FAILED") from cause

    def query(self, query: str, limit: int = 10, asked: list[str] | None = None, language: str | None = None) -> dict:
        began = time.time()
        rows = self.search(query, U.whole_limit(limit), asked, language) if U.whole_limit(limit) else []
        results = [{k: r[k] for k in ("file", "lines", "name", "type", "score", "snippet", "language")} for r in rows]
        stats = {"strategies": U.strategies_for(query, asked), "totalResults": len(results), "searchTimeMs": round((time.time() - began) * 1000)}
        return {"query": query, "results": results, "stats": stats, "text": hybrid.as_text(query, rows)}

    def ask(self, query: str, limit: int = 10, provider=None, explained: bool = True) -> steering.Steered:
        return steering.ask(query, lambda plan: [r.asDict() for r in self.search(query, limit, plan=plan)], provider, explained)

    def refresh(self, changes, _: int = 0) -> dict:
        """Bring the index up to the paths of a batch of changes."""
        return self.index.update(discovery.discovered(self.spark, self.root), changes.select("path"))

    def follow(self, feed: str, checkpoint: str, gap_ms: int, once: bool = False, embed: bool = False):
        """Follow a feed of change events for this tree; embedding is off unless asked for."""

        def handle(batch, number):
            self.refresh(batch.where(watch.watched(F.col("path"), self.settings.get("watch.ignored"))), number)
            if embed:
                self.index.embed(self.embedder)

        return watch.follow(watch.debounced(watch.events(self.spark, feed), f"{gap_ms} milliseconds"), handle, checkpoint, once)

    def status(self) -> dict:
        said = self.index.status()
        wanted = self.settings.read()["embedder"]
        warning = None if said["embedder"] in (None, wanted["provider"]) else f"the index was embedded by {said['embedder']}, the settings name {wanted['provider']}"
        return said | {"warning": warning}


def status_text(root: str, said: dict) -> str:
    size = lambda n: f"{n:,}"
    out = [f"Status of {root}", "", f"  Files:    {size(said['files'])}", f"  Chunks:   {size(said['chunks'])}", f"  Vectors:  {size(said['vectors'])}"]
    if said["last_indexed"]:
        out.insert(2, f"  Indexed:  {said['last_indexed']:%Y-%m-%d %H:%M:%S}")
    if said["languages"]:
        width = max(len(k or "unknown") for k in said["languages"]) + 2
        out += ["", "  Languages:"] + [f"    {(k or 'unknown').capitalize():{width}}{n} file{'s' * (n != 1)}" for k, n in said["languages"].items()]
    return "\n".join([*out, *([f"  Warning: {said['warning']}"] if said.get("warning") else [])])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seekspark", description="Hybrid search over source trees")
    top.add_argument("--verbose", action="store_true")
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, *aliases, path=True):
        c = commands.add_parser(name, aliases=aliases)
        if path:
            c.add_argument("path", nargs="?", default=".")
        else:
            c.add_argument("--path", default=".")
        return c

    command("init")
    command("update")
    q = command("query", "find", path=False)
    q.add_argument("query")
    q.add_argument("-l", "--limit", type=float, default=10)
    q.add_argument("-s", "--strategy")
    q.add_argument("--language")
    q.add_argument("-f", "--format", choices=("json", "text"), default="json")
    a = command("ask", path=False)
    a.add_argument("query")
    a.add_argument("-l", "--limit", type=float, default=10)
    a.add_argument("-p", "--provider")
    a.add_argument("-f", "--format", choices=("json", "text"), default="text")
    a.add_argument("--no-explain", action="store_true")
    w = command("watch")
    w.add_argument("--feed", required=True)
    w.add_argument("--init", action="store_true")
    w.add_argument("--debounce", type=int)
    w.add_argument("--embed", action="store_true")
    w.add_argument("--once", action="store_true")
    command("status")
    c = command("config", path=False)
    c.add_argument("action", choices=("show", "get", "set", "reset"))
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    s = command("symbols", path=False)
    s.add_argument("name", nargs="?")
    s.add_argument("--type")
    s.add_argument("-l", "--limit", type=int, default=50)
    d = command("deps", path=False)
    d.add_argument("chunk", type=int)
    d.add_argument("--direction", choices=("imports", "importedBy"), default="imports")
    d.add_argument("--depth", type=int, default=2)
    k = command("chunk", path=False)
    k.add_argument("file")
    commands.add_parser("auth")
    return top


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> str:
    """The output of one command."""
    if args.command == "config":
        settings = X.Settings(args.path)
        if args.action == "set":
            return settings.set(args.key, args.value) or ""
        if args.action == "reset":
            return settings.reset(args.key) or ""
        return json.dumps(settings.read() if args.action == "show" else settings.get(args.key), indent=2)
    if args.command == "auth":
        return "\n".join(f"{name}: {'set' if os.environ.get(key) else 'not set'} ({key})" for name, key in V.PROVIDERS.items())
    project = Project(spark or session(), args.path, create=args.command == "init" or getattr(args, "init", False))
    if args.command in ("init", "update"):
        return json.dumps(project.init())
    if args.command in ("query", "find"):
        said = project.query(args.query, args.limit, args.strategy.split(",") if args.strategy else None, args.language)
        return said["text"] if args.format == "text" else json.dumps({k: v for k, v in said.items() if k != "text"}, indent=2)
    if args.command == "ask":
        provider = steering.detect(http.asked, args.provider or project.settings.get("llm.provider"))
        said = project.ask(args.query, U.whole_limit(args.limit), provider, not args.no_explain)
        if args.format == "text":
            listed = [f"{n}. {r['file']}:{r['lines'][0]}-{r['lines'][1]} (score: {r['score']:g})" for n, r in enumerate(said.results, 1)]
            return "\n".join([said.interpretation, "", *listed, *(["", said.explanation] if said.explanation else []), *(["", f"{said.tokens} tokens, ${said.cost:.4f}"] if said.tokens else [])])
        return json.dumps({"query": args.query, "interpretation": said.interpretation, "strategies": said.strategies, "results": said.results, "explanation": said.explanation, "tokens": said.tokens, "cost": said.cost}, indent=2, default=str)
    if args.command == "watch":
        if args.init:
            project.init()
        gap = project.settings.get("watch.debounceMs") if args.debounce is None else args.debounce
        project.follow(args.feed, os.path.join(project.folder, "watch"), gap, args.once, args.embed).awaitTermination()
        return ""
    if args.command == "status":
        return status_text(project.root, project.status())
    if args.command == "symbols":
        rows = symbols.search(project.index.corpus(), args.name, args.type, limit=args.limit).collect()
        return json.dumps([r.asDict() for r in rows])
    if args.command == "deps":
        starts = project.spark.createDataFrame([(args.chunk,)], "start long")
        return json.dumps([r.asDict() for r in graph.trace(project.index.table("dependencies"), starts, args.direction, args.depth).collect()])
    rows = project.index.corpus().where(F.col("path") == args.file).orderBy("line_start", "id").collect()
    return json.dumps([{k: r[k] for k in ("id", "line_start", "line_end", "type", "name")} for r in rows])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if args.verbose or os.environ.get("CTX_DEBUG") == "1" else logging.INFO, format="%(levelname)s %(message)s")
    try:
        print(run(args))
    except Exception as error:
        LOG.error("%s", f"[{error.code}] {error}" if isinstance(error, SeekError) else f"unexpected: {error}", exc_info=args.verbose)
        return exit_code(error)
    return 0


if __name__ == "__main__":
    sys.exit(main())
