import sqlite3

import pytest
from pyspark.sql import functions as F

from seekspark.errors import SearchError
from seekspark.operators import fulltext, fusion, graph, paths, symbols, vectors
from seekspark.plans import understanding as U

CORPUS = "id long, file_id long, path string, language string, line_start int, line_end int, type string, name string, parent string, text string, exports boolean"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [
            (1, 1, "src/auth/token.ts", "typescript", 1, 9, "function", "createToken", None, "creates a token for a user", True),
            (2, 1, "src/auth/token.ts", "typescript", 10, 12, "function", "checkToken", None, "checks the token of the user; a token ends", False),
            (3, 2, "src/db/pool.py", "python", 1, 20, "function", "create_pool", "Pool", "create pool of connections", None),
            (4, 3, "tests/auth.test.ts", "typescript", 1, 30, "import", None, None, "import token from créé", False),
            (5, 3, "tests/auth.test.ts", "typescript", 31, 60, "constant", "LIMITS", None, None, False),
        ],
        CORPUS,
    ).cache()


@pytest.mark.parametrize("query", ["token", "token user", "create_pool", "creat*", "token OR pool", "token NOT user", "cree", "pool AND create OR checks", "nothing"])
def test_bm25_equals_another_engine(spark, corpus, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, text, parent)")
    con.executemany("INSERT INTO t(rowid, name, text, parent) VALUES (?, ?, ?, ?)", [(r.id, r.name, r.text, r.parent) for r in corpus.collect()])
    want = {r: -s for r, s in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank", (fulltext.sanitise(query),))}
    positions, lengths = fulltext.postings(corpus, "id", ["name", "text", "parent"])
    got = {r.key: r.bm25 for r in fulltext.ranked(positions, lengths, {0: fulltext.sanitise(query)}, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = fulltext.ranked_few(fulltext.scanned(corpus, "id", ["name", "text", "parent"], [fulltext.sanitise(query)]), {0: fulltext.sanitise(query)}, 10)
    assert {r.key: round(r.bm25, 9) for r in few.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_fulltext_order_limit_language(corpus):
    found = fulltext.search(corpus, {0: "token"}, 2).orderBy("rank").collect()
    assert len(found) == 2 and found[0].score > found[1].score
    best = fulltext.search(corpus, {0: "token"}, 2, order="bm25").orderBy("rank").collect()
    assert best[0].score < best[1].score
    assert [r.chunk_id for r in fulltext.search(corpus, {0: "create*"}, 5, language="python").collect()] == [3]


@pytest.mark.parametrize("query", ["AND a", "a OR", "NOT a", "a OR OR b"])
def test_broken_queries(query):
    with pytest.raises(SearchError):
        fulltext.parse(query)


@pytest.mark.parametrize("given, clean", [("a-b c", "a b c"), ("auth*", "auth*"), ("a*b", "ab"), ("***", ""), ('say "hi"', "say hi"), ("x** y", "x* y"), ("", ""), ("snake_case", "snake_case")])
def test_sanitise(spark, given, clean):
    from seekspark.functions.text import sanitised

    assert fulltext.sanitise(given) == clean
    assert spark.createDataFrame([(given,)], "q string").select(sanitised("q")).first()[0] == clean


def test_symbols(corpus):
    ids = lambda d: [r.chunk_id for r in d.orderBy("rank").collect()]
    assert ids(symbols.search(corpus, "create_pool", mode="exact")) == [3]
    assert ids(symbols.search(corpus, "CREATE", mode="prefix")) == [1, 3]
    assert ids(symbols.search(corpus, "e_t")) == [1, 3]
    assert ids(symbols.search(corpus, "e_t", literal=True)) == []
    assert ids(symbols.search(corpus, kind="function", language="typescript", limit=1)) == [2]
    assert ids(symbols.search(corpus, limit=1)) == [4]


@pytest.mark.parametrize("glob, path, fits", [("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("a/**/b", "a/b", True), ("a/**/b", "a/xb", True), ("**/?.py", "x/y.py", True), ("a.b", "axb", False), ("[x]", "[x]", True)])
def test_globs(spark, glob, path, fits):
    from seekspark.functions.text import glob_pattern

    assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(glob_pattern(glob))).first()[0] == fits


def test_path_keywords_take_turns(spark, corpus):
    files = corpus.select(F.col("file_id").alias("id"), "path", "language").distinct()
    queries = spark.createDataFrame([(0, ["auth"])], "query_id long, terms array<string>")
    found = paths.by_keywords(files, corpus, queries, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [(1, 1.0), (4, 0.7), (2, 1.0)]


def test_fusion_and_penalties(spark, corpus):
    lists = spark.createDataFrame([(0, 0, 1.0, 4, 1), (0, 0, 1.0, 1, 2), (0, 1, 0.5, 1, 1), (0, 1, 0.5, 5, 2)], "query_id long, position int, weight double, chunk_id long, rank int")
    fused = {r.chunk_id: r for r in fusion.fused(lists, 10).collect()}
    assert fused[1].place == 1 and fused[1].score == 1.0
    assert abs(fused[4].score - (1 / 61) / (1 / 62 + 0.5 / 61)) < 1e-12
    terms = spark.createDataFrame([(0, ["auth"])], "query_id long, terms array<string>")
    best = fusion.reranked(fusion.fused(lists, 10), corpus, terms, 10).orderBy("place").collect()
    assert [r.chunk_id for r in best] == [1, 5, 4] or [r.chunk_id for r in best] == [1, 4, 5]
    assert best[0].score == 1.0
    zero = lists.withColumn("weight", F.lit(0.0))
    assert {r.score for r in fusion.fused(zero, 10).collect()} == {0.0}
    assert fusion.fused(lists.limit(0), 10).count() == 0


def test_vectors(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0])], "chunk_id long, vector array<float>")
    found = vectors.nearest(stored, [(7, [1.0, 0.0])], 3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 3)) for r in found] == [(1, 1.0), (3, 1.0), (2, 0.414)]


def test_trace(spark):
    edges = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (1, 4), (4, 4)], "src long, dst long")
    start = spark.createDataFrame([(4,)], "start long")
    got = {r.chunk_id: (r.depth, round(r.score, 6)) for r in graph.trace(edges, start, "imports", 2).collect()}
    assert got == {3: (1, 1.0), 2: (2, 0.8)}
    assert {r.chunk_id for r in graph.trace(edges, start, "importedBy", 9).collect()} == {1, 2, 3}


@pytest.mark.parametrize("query, kind", [("src/a", "path"), ("x.TS", "path"), ("createToken", "symbol"), ("word", "symbol"), ("AUTH_KEY", "symbol"), ("how it goes", "natural_language"), ("rows of the table", "natural_language"), ("token cache", "keyword"), ("of the", "keyword")])
def test_classes(spark, query, kind):
    assert U.kind_of(query) == kind
    assert spark.createDataFrame([(query,)], "q string").select(U.classified(F.col("q"))).first()[0] == kind


def test_terms_and_plans():
    assert U.search_terms("how does authentication work?") == "authentication auth work"
    assert U.search_terms("where is fs.readFileSync used") == "fs.readFileSync"
    assert U.search_terms("the") == "the" and U.search_terms("??") == "??"
    assert U.symbol_names("create_pool AUTH parseHTML") == ["create", "pool", "AUTH", "parse", "HTML"] or U.symbol_names("create_pool")[:2] == ["create", "pool"]
    assert U.strategies_for("how is it done", None)[-1] == "vector" and U.strategies_for("x", ["fts"]) == ["fts"]
    good = U.plan_from('so: {"interpretation": "x", "strategies": [{"strategy": "fts", "query": "a", "weight": 1}, {"strategy": "nope"}]}', "q")
    assert [s["strategy"] for s in good["strategies"]] == ["fts"]
    assert [s["strategy"] for s in U.plan_from("nothing", "q")["strategies"]] == ["vector", "fts", "ast", "path"]
    with pytest.raises(ValueError):
        U.plan_from("{broken}", "q")
    assert (U.whole_limit(2.9), U.whole_limit(-1), U.whole_limit(float("inf"))) == (2, 0, 0)
