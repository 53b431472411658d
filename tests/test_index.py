import json

import pytest
from pyspark.sql import functions as F

from seekspark import cli, settings
from seekspark.errors import SettingsError, StoreError, exit_code
from seekspark.functions.embedding import HashingEmbedder, HttpEmbedder
from seekspark.operators import changes, chunking
from seekspark.plans import steering
from seekspark.sources import discovery, parsing, store

TS = '''import { a } from "./a";
/** Adds numbers. */
export function add(x: number, y = 2): number {
  return x + y; // }
}

export class Pool extends Base {
  private size = 3;
  /** Opens it. */
  async open(name: string): Promise<void> { if (name) { return; } }
  close() {}
}
interface Row { id: number }
export type Name = string | null;
const LIMIT = 3;
export const handler = async (e) => {
  return `${e}`;
};
function broken( {
'''
PY = '''import os
from a import b

LIMIT = 3

@cached
def load(path, *more, key=None) -> dict:
    """Loads a file."""
    return {}


class Store(Base):
    """Keeps rows."""

    def get(self, key):
        return key
'''


def test_parsers():
    found = [dict(zip(parsing.FIELDS, n)) for n in parsing.parse(TS, "typescript")]
    assert [(n["type"], n["name"], n["line_start"], n["line_end"]) for n in found][:8] == [("import", None, 1, 1), ("function", "add", 3, 5), ("class", "Pool", 7, 12), ("method", "open", 10, 10), ("method", "close", 11, 11), ("type", "Row", 13, 13), ("type", "Name", 14, 14), ("constant", "LIMIT", 15, 15)]
    assert found[1]["params"] == ["x", "y"] and found[1]["return_type"] == "number" and found[1]["docstring"] == "Adds numbers." and found[1]["exports"]
    assert found[3]["parent"] == "Pool" and found[3]["docstring"] == "Opens it."
    assert found[8]["name"] == "handler" and found[8]["line_end"] == 18
    found = [dict(zip(parsing.FIELDS, n)) for n in parsing.parse(PY, "python")]
    assert [(n["type"], n["name"], n["line_start"]) for n in found] == [("import", None, 1), ("import", None, 2), ("constant", "LIMIT", 4), ("function", "load", 6), ("class", "Store", 12), ("method", "get", 15)]
    assert found[3]["params"] == ["path", "*more", "key", ] and found[3]["docstring"] == "Loads a file." and found[5]["params"] == ["key"]
    broken = [dict(zip(parsing.FIELDS, n)) for n in parsing.parse(PY + "def x(:\n", "python")]
    assert [n["name"] for n in broken][2:6] == ["LIMIT", "load", "Store", "get"]
    assert parsing.parse("x", "rust") == []


@pytest.fixture
def tree(tmp_path):
    for name, text in {"src/a.ts": TS, "src/b.py": PY, "build/c.py": "x = 1", "x.lock": "", "README.md": "# hi", "notes.txt": "no", ".env": "A=1", "skip/me.py": "x = 1"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / ".gitignore").write_text("# c\nskip/\n*.md\n!README.md\n")
    return tmp_path


def test_discovery(spark, tree):
    want = [".env", "README.md", "src/a.ts", "src/b.py"]
    assert [p for p, _, _ in discovery.listed(str(tree))] == want
    found = discovery.discovered(spark, str(tree)).orderBy("path").collect()
    assert [r.path for r in found] == [p for p in want if p != ".env"] or [r.path for r in found] == want
    assert {r.path: r.language for r in found}["src/b.py"] == "python"


def test_index_life(spark, tree):
    root = str(tree)
    project = cli.Project(spark, root, create=True)
    first = project.init()
    assert first["added"] >= 3 and first["embedded"] > 0
    assert ".ctx/" in (tree / ".gitignore").read_text().splitlines()
    ids = {r.path: r.id for r in project.index.table("files").collect()}
    (tree / "src/b.py").write_text(PY.replace("load", "fetchRows"))
    (tree / "src/a.ts").unlink()
    again = project.init()
    assert (again["modified"], again["deleted"], again["added"]) == (1, 1, 0)
    kept = {r.path: r.id for r in project.index.table("files").collect()}
    assert kept["src/b.py"] == ids["src/b.py"] and "src/a.ts" not in kept
    names = {r.name for r in project.index.table("chunks").collect()}
    assert "fetchRows" in names and "add" not in names
    assert project.index.table("chunks").join(project.index.table("chunk_vectors").select(F.col("chunk_id").alias("id")), "id", "left_anti").count() == 0
    said = project.query("fetchRows", 5)
    assert said["results"][0]["name"] == "fetchRows" and "fetchRows" in said["text"]
    assert project.query("fetchRows", 0)["results"] == [] and project.query("how does the store keep rows")["stats"]["strategies"][-1] == "vector"
    assert project.ask("where is fetchRows").strategies[0]["strategy"] == "vector"
    (tree / "src/new.py").write_text("def brandNew():\n    return 1\n")
    assert project.refresh(spark.createDataFrame([("src/new.py", "add")], "path string, type string")) == {"added": 1, "modified": 0, "deleted": 0, "unchanged": 0}
    (tree / "src/new.py").unlink()
    assert project.refresh(spark.createDataFrame([("src/new.py", "unlink")], "path string, type string"))["deleted"] == 1
    kept = {r.path: r.id for r in project.index.table("files").collect()}
    shown = cli.run(cli.parser().parse_args(["query", "fetchRows", "--path", root, "-f", "text", "-l", "2"]), spark)
    assert shown.startswith('Results for "fetchRows"')
    assert json.loads(cli.run(cli.parser().parse_args(["symbols", "fetchRows", "--path", root]), spark))
    assert json.loads(cli.run(cli.parser().parse_args(["chunk", "src/b.py", "--path", root]), spark))[0]["type"] == "import"
    assert cli.run(cli.parser().parse_args(["deps", "1", "--path", root]), spark) == "[]"
    assert "gemini" in cli.run(cli.parser().parse_args(["auth"]), spark)
    status = project.status()
    assert status["languages"]["python"] == 1 and status["warning"] is None and "Chunks" in cli.status_text(root, status)
    version = project.index.version
    project.index.vacuum()
    assert project.index.version == version and project.index.table("files").count() == len(kept)
    with pytest.raises(StoreError):
        project.index.check(12)
    assert project.query("fetchRows", 5)["results"][0]["name"] == "fetchRows"
    assert project.index.embed(project.embedder, 3) == 0
    project.index.commit(chunk_vectors=project.index.table("chunk_vectors").limit(0))
    assert project.index.embed(project.embedder, 3) == project.index.table("chunks").count() == project.index.table("chunk_vectors").count()
    version = project.index.version
    edited = json.loads((tree / ".ctx/index" / f"v={version}" / "manifest.json").read_text()) | {"dimensions": "x"}
    (tree / ".ctx/index" / f"v={version}" / "manifest.json").write_text(json.dumps(edited))
    with pytest.raises(StoreError):
        project.index.check(384)


def test_failed_commit_keeps_the_old_snapshot(spark, tmp_path):
    index = store.Index.create(spark, str(tmp_path / "i"), 384)
    boom = spark.range(1).select(F.raise_error(F.lit("x")).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), F.lit("t").alias("type"))
    with pytest.raises(StoreError):
        index.commit(dependencies=boom)
    assert index.version == 0 and index.table("dependencies").count() == 0


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "python", "h1", 1), (5, "b", "python", "h2", 1)], "id long, path string, language string, hash string, size long")
    new = spark.createDataFrame([("b", "python", "h3", 2), ("d", "python", "h4", 2), ("c", "python", "h5", 2)], "path string, language string, hash string, size long")
    assert {r.path: r.status for r in changes.compared(new, old).collect()} == {"a": "deleted", "b": "modified", "c": "added", "d": "added"}
    assert {r.path: r.id for r in changes.upserted(old, new).collect()} == {"a": 1, "b": 5, "c": 6, "d": 7}
    assert {r.path: r.id for r in changes.upserted(old.limit(0), new).collect()} == {"b": 1, "c": 2, "d": 3}


def test_sessions(spark):
    rows = spark.createDataFrame([("r", "p", t, s) for t, s in [("add", "2025-01-01 00:59:59.8"), ("change", "2025-01-01 01:00:00.3"), ("unlink", "2025-01-01 01:00:00.801")]], "repo string, path string, type string, at string").select("repo", "path", "type", F.to_timestamp("at").alias("ts"))
    got = sorted((r.session, r.type) for r in changes.latest_changes(rows).collect())
    assert got == [(1, "change"), (2, "unlink")]


def test_chunks(spark):
    nodes = spark.createDataFrame(
        [
            (1, 1, "a.ts", "import", None, None, 1, 1, "import a", None),
            (2, 1, "a.ts", "import", None, None, 2, 2, "import b", None),
            (3, 1, "a.ts", "class", "K", None, 4, 9, "class K {}", True),
            (4, 1, "a.ts", "method", "m", "K", 5, 6, "m() {}", True),
            (5, 1, "a.ts", "constant", None, None, 11, 11, "const a = 1", False),
            (6, 1, "a.ts", "constant", "B", None, 12, 12, "const B = 2", False),
            (7, 1, "a.ts", "function", "f", None, 20, 25, "\n".join(["w " * 100] * 6), None),
        ],
        "node_id long, file_id long, path string, type string, name string, parent string, line_start int, line_end int, text string, exports boolean",
    )
    got = [(r.type, r.name, r.line_start, r.line_end) for r in chunking.chunked(nodes).orderBy("line_start").collect()]
    assert got == [("import", None, 1, 2), ("method", "m", 5, 6), ("constant", "B", 11, 12), ("function", "f", 20, 22), ("function", "f", 23, 25)]


def test_settings(tmp_path):
    with pytest.raises(SettingsError) as missing:
        settings.Settings(str(tmp_path))
    assert exit_code(missing.value) == 1 and exit_code(ValueError()) == 2
    said = settings.prepare(str(tmp_path))
    said.set("search.defaultLimit", "7")
    said.set("watch.ignored", '["x"]')
    assert said.get("search.defaultLimit") == 7 and said.get("watch.ignored") == ["x"] and said.get("no.such") is None
    for key, text in (("embedder.provider", "nope"), ("embedder.dimensions", "1.5"), ("watch.debounceMs", "-1"), ("llm.provider", "x")):
        with pytest.raises(SettingsError):
            said.set(key, text)
    said.reset("search.defaultLimit")
    assert said.get("search.defaultLimit") == 10
    with pytest.raises(SettingsError):
        said.reset("no.such")
    assert cli.run(cli.parser().parse_args(["config", "--path", str(tmp_path), "get", "search.defaultLimit"])) == "10"


def test_embedders():
    a, b, empty = HashingEmbedder().embed(["openPool rows", "rows openPool", ""])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(empty)
    calls, waits = [], []

    def transport(url, headers, body):
        calls.append(body)
        return (429, {}) if len(calls) < 3 else (200, {"data": [{"index": i, "embedding": [1.0]} for i in range(len(body["input"]))]})

    assert HttpEmbedder("voyage", "k", transport, 1, waits.append).embed(["x"], query=True) == [[1.0]]
    assert waits == [0.5, 1.0] and calls[0]["input_type"] == "query"
    with pytest.raises(Exception):
        HttpEmbedder("openai", "k", lambda *a: (500, {}), 1).embed(["x"])


def test_steering():
    class Model:
        name = "test"

        def __init__(self, *answers):
            self.answers = list(answers)

        def chat(self, prompt, system):
            if not self.answers:
                raise OSError
            return self.answers.pop(0)

    row = {"file": "a", "lines": [1, 2], "name": "n", "type": "function", "score": 1.0, "snippet": "s" * 400}
    plan = '{"interpretation": "i", "strategies": [{"strategy": "fts", "query": "a", "weight": 1}]}'
    said = steering.ask("q", lambda p: [row], Model(plan, "because"))
    assert said.explanation == "because" and said.tokens > 0 and said.cost == said.tokens / 1e6 * 0.15
    assert steering.ask("q", lambda p: [], Model(plan)).explanation == steering.NOTHING_FOUND
    assert steering.ask("q", lambda p: [row], Model(plan)).explanation == steering.NO_EXPLANATION
    assert [s["strategy"] for s in steering.ask("q", lambda p: [row], Model("{bad")).strategies] == ["vector", "fts", "ast", "path"]
    assert steering.detect(None, environment={}) is None
    assert steering.detect(None, environment={"CTX_OPENAI_KEY": "k"}).name == "openai" and steering.detect(None, "gemini", {"CTX_OPENAI_KEY": "k"}) is None


def test_watch_stream(spark, tmp_path):
    from seekspark.streaming import watch

    feed = tmp_path / "feed"
    rows = spark.createDataFrame([("r/a.py", "add", "2025-01-01 00:00:00.0"), ("r/a.py", "change", "2025-01-01 00:00:00.3"), ("r/b.txt", "add", "2025-01-01 00:00:00.4"), ("r/c.py", "add", "2025-01-03 00:00:05")], "path string, type string, at string")
    rows.select("path", "type", F.to_timestamp_ntz("at").alias("ts"), F.to_timestamp_ntz("at").alias("received_at")).write.parquet(str(feed))
    extra = rows.limit(1).select("path", F.lit("unlink").alias("type"), F.to_timestamp_ntz(F.lit("2025-01-09 00:00:00")).alias("ts"), F.to_timestamp_ntz(F.lit("2025-01-09 00:00:00")).alias("received_at"))
    extra.write.mode("append").parquet(str(feed))
    got = []

    def handle(batch, number):
        got.extend((r.path, r.type) for r in batch.where(watch.watched(F.col("path"))).collect())
        raise RuntimeError("the stream goes on")

    watch.follow(watch.debounced(watch.events(spark, str(feed))), handle, str(tmp_path / "state"), once=True).awaitTermination()
    assert ("r/a.py", "change") in got and ("r/b.txt", "add") not in got and ("r/a.py", "unlink") not in got


def test_providers():
    calls = []

    def transport(url, headers, body):
        calls.append((url, headers, body))
        return {"candidates": [{"content": {"parts": [{"text": "g"}]}}], "choices": [{"message": {"content": "o"}}], "content": [{"text": "a"}]}

    assert [steering.HttpProvider(n, "k", transport).chat("p", "s") for n in ("gemini", "openai", "anthropic")] == ["g", "o", "a"]
    assert calls[1][1] == {"Authorization": "Bearer k"} and calls[2][2]["system"] == "s"


def test_ignore_rules():
    hidden = lambda rule, path: bool(__import__("re").search(discovery.rule_pattern(rule)[0], path))
    assert hidden("dist", "a/dist/b.js") and hidden("*.lock", "a/x.lock") and not hidden("dist", "a/distant.js")
    assert hidden("/build/", "build/x") and not hidden("/build/", "a/build/x") and hidden("a/**/b", "a/x/y/b") and hidden("docs/", "x/docs/y") and not hidden("docs/", "x/docs")
    assert discovery.rule_pattern("!keep.md")[1] is False
    assert [discovery.language(p) for p in ("a.TS", "x/.env", "a.unknown", "Makefile", "b.d.ts")] == ["typescript", "env", None, None, "typescript"]
