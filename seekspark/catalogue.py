"""The queries over the test tables, by name, and their SQL twins.

Every query runs over its whole tables.  The twins are written for another engine and share nothing but the values:
each states in SQL what the DataFrame program computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.functions import text as T
from seekspark.functions.embedding import prepared
from seekspark.operators import changes, chunking, fulltext, fusion, graph, paths, symbols, vectors
from seekspark.plans import hybrid
from seekspark.plans import understanding as U
from seekspark.shared import table
from seekspark.sources import tables as S

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query and, where SQL can say it, its twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# The cleaned tables in SQL.
SQL_FILES = "f AS (SELECT DISTINCT id, repo, path, lower(trim(language)) AS language, hash, last_indexed, size FROM files)"
SQL_CHUNKS = "c AS (SELECT DISTINCT id, file_id, line_start, coalesce(line_end, line_start) AS line_end, type, name, parent, coalesce(text, '') AS text, exports FROM chunks)"
SQL_CORPUS = f"{SQL_FILES}, {SQL_CHUNKS}, k AS (SELECT c.*, f.path, f.language FROM c JOIN f ON f.id = c.file_id)"
SQL_VECTORS = """u AS (
    SELECT chunk_id, vector::DOUBLE[] AS vector FROM (
        SELECT chunk_id, vector, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC, vector DESC) AS n
        FROM (SELECT DISTINCT chunk_id, vector, embedded_at FROM embedding_results
              WHERE len(vector) = 384 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
    ) WHERE n = 1)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_tokens(field: str) -> str:
    return f"list_filter(string_split_regex(translate(lower(coalesce({field}, '')), '{T.ACCENTED}', '{T.UNACCENTED}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_fulltext(text: str, limit: int, language: str | None = None, order: str = "reference", only: str = "") -> str:
    """CTEs ending in ``fts(chunk_id, score, rank)`` for one query; ``only`` makes their names distinct."""
    phrases, conjunctions = fulltext.parse(fulltext.sanitise(text))

    def count(tokens, parts, prefix):
        test = lambda i, at: f"starts_with({at}, {quoted(parts[i])})" if prefix and i == len(parts) - 1 else f"{at} = {quoted(parts[i])}"
        if len(parts) == 1:
            return f"len(list_filter({tokens}, lambda t: {test(0, 't')}))"
        every = " AND ".join(test(i, f"{tokens}[i + {i}]") for i in range(len(parts)))
        return f"len(list_filter(generate_series(1, greatest(0, len({tokens}) - {len(parts) - 1})), lambda i: {every}))"

    found = ", ".join(f"{' + '.join(count(t, *p) for t in ('a', 'b', 'd'))} AS f{n}" for n, p in enumerate(phrases))
    held = ", ".join(f"count(*) FILTER (f{n} > 0) AS n{n}" for n in range(len(phrases)))
    idf = lambda n: f"(CASE WHEN ln((rows - n{n} + 0.5e0) / (n{n} + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((rows - n{n} + 0.5e0) / (n{n} + 0.5e0)) END)"
    parts = " + ".join(f"CASE WHEN f{n} > 0 THEN {idf(n)} * f{n} * 2.2e0 / (f{n} + 1.2e0 * (0.25e0 + 0.75e0 * length / mean)) ELSE 0 END" for n in range(len(phrases)))
    fits = " OR ".join("(" + " AND ".join(f"f{n} {'>' if w else '='} 0" for n, w in sorted(c)) + ")" for c in conjunctions)
    by = "round(score, 9) DESC, place" if order == "reference" else "place"
    keep = f"WHERE chunk_id IN (SELECT id FROM k WHERE language = {quoted(language)})" if language else ""
    return f"""
        t{only} AS (SELECT id, {sql_tokens('name')} AS a, {sql_tokens('text')} AS b, {sql_tokens('parent')} AS d FROM k),
        o{only} AS (SELECT id, len(a) + len(b) + len(d) AS length, {found} FROM t{only}),
        s{only} AS (SELECT count(*) AS rows, avg(length) AS mean, {held} FROM o{only}),
        r{only} AS (SELECT id AS chunk_id, {parts} AS bm25 FROM o{only}, s{only} WHERE {fits}),
        p{only} AS (SELECT chunk_id, 1 / (1 + bm25) AS score, row_number() OVER (ORDER BY round(bm25, 9) DESC, chunk_id) AS place FROM r{only}),
        fts{only} AS (SELECT * FROM (SELECT chunk_id, score, row_number() OVER (ORDER BY {by}) AS rank FROM (SELECT * FROM p{only} WHERE place <= {limit * 3 if language else limit}) {keep}) WHERE rank <= {limit})"""


def sql_fulltext_query(text: str, limit: int, **options) -> str:
    return f"WITH {SQL_CORPUS}, {sql_fulltext(text, limit, **options)} SELECT chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM fts"


def shown(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# Full-text search.


@query(sql_fulltext_query("cache session", 30))
def fts_and_two_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "cache session"}, 30))


@query(sql_fulltext_query("ledger", 20))
def fts_single_term_reference_order(spark, sf_dir):
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "ledger"}, 20))


@query(sql_fulltext_query("ledger", 20, order="bm25"))
def fts_single_term_best_first(spark, sf_dir):
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "ledger"}, 20, order="bm25"))


@query(sql_fulltext_query("snap* row", 25))
def fts_prefix(spark, sf_dir):
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "snap* row"}, 25))


@query(sql_fulltext_query("throw_new_error session", 25))
def fts_phrase(spark, sf_dir):
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "throw_new_error session"}, 25))


@query(sql_fulltext_query("ledger OR posting NOT cache", 40))
def fts_or_not(spark, sf_dir):
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "ledger OR posting NOT cache"}, 40))


@query(sql_fulltext_query("window", 15, language="python"))
def fts_language_postfilter(spark, sf_dir):
    return shown(fulltext.search(S.corpus(spark, sf_dir), {0: "window"}, 15, language="python"))


BATCH = {1: "session cache", 2: "build_row", 3: "order*", 4: "graph OR edge", 5: "token NOT parser", 6: "?!"}
_batch = [(q, t) for q, t in BATCH.items() if fulltext.sanitise(t)]


@query(f"WITH {SQL_CORPUS}, " + ", ".join(sql_fulltext(t, 10, only=f"_{q}") for q, t in _batch) + " " + " UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM fts_{q}" for q, _ in _batch))
def fts_batch_queries(spark, sf_dir):
    found = fulltext.search(S.corpus(spark, sf_dir), BATCH, 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_*]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(t, ' +'),
        lambda w: CASE WHEN replace(w, '*', '') = '' THEN '' ELSE replace(w, '*', '') || CASE WHEN ends_with(w, '*') THEN '*' ELSE '' END END), lambda w: w <> ''), ' ') AS query FROM d"""
)
def fts_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitised(F.coalesce("text", F.lit(""))).alias("query"))


# Vectors.


def _examples(spark, sf_dir):
    """The vectors of the three chunks with the smallest ids."""
    return [(r.chunk_id, r.vector) for r in S.usable_vectors(spark, sf_dir).orderBy("chunk_id").limit(3).collect()]


SQL_KNN = f"""WITH {SQL_VECTORS}, {SQL_CORPUS},
    q AS (SELECT chunk_id AS query_id, vector AS wanted FROM u ORDER BY chunk_id LIMIT 3),
    n AS (SELECT query_id, chunk_id, list_distance(vector, wanted) AS d FROM u, q),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) AS rank FROM n)"""


@query(f"{SQL_KNN} SELECT query_id, chunk_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score, rank::INTEGER AS rank FROM g WHERE rank <= 10")
def vector_knn(spark, sf_dir):
    found = vectors.nearest(S.usable_vectors(spark, sf_dir), _examples(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"{SQL_KNN} SELECT query_id, chunk_id, round(1 / (1 + d), 6) AS score, rank::INTEGER AS rank FROM g JOIN k ON k.id = g.chunk_id WHERE rank <= 30 AND language = 'python'")
def vector_knn_language_postfilter(spark, sf_dir):
    found = vectors.nearest(S.usable_vectors(spark, sf_dir), _examples(spark, sf_dir), 30)
    kept = found.join(S.corpus(spark, sf_dir).where("language = 'python'").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return kept.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {SQL_VECTORS}, q AS (SELECT vector AS wanted FROM u ORDER BY chunk_id LIMIT 1) SELECT chunk_id, round(list_cosine_similarity(vector, wanted), 6) AS cosine FROM u, q")
def vector_cosine(spark, sf_dir):
    found = S.usable_vectors(spark, sf_dir)
    first = found.orderBy("chunk_id").limit(1).select(F.col("vector").alias("wanted"))
    return found.join(F.broadcast(first)).select("chunk_id", F.round(T.cosine("vector", "wanted"), 6).alias("cosine"))


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6)) AS vector FROM embeddings")
def vector_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(T.unit_vector("embedding"), lambda x: F.round(x, 6)).alias("vector"))


# Symbols.


def _named(mode, score, where):
    return f"WITH {SQL_CORPUS} SELECT id AS chunk_id, {score}::DOUBLE AS score, (row_number() OVER (ORDER BY name NULLS FIRST, line_start, id))::INTEGER AS rank FROM (SELECT * FROM k WHERE {where} ORDER BY name NULLS FIRST, line_start, id LIMIT 20)"


@query(_named("exact", 1.0, "name = 'constructor'"))
def ast_exact(spark, sf_dir):
    return shown(symbols.search(S.corpus(spark, sf_dir), "constructor", mode="exact", limit=20))


@query(_named("prefix", 0.8, "name ILIKE 'sort%'"))
def ast_prefix(spark, sf_dir):
    return shown(symbols.search(S.corpus(spark, sf_dir), "Sort", mode="prefix", limit=20))


@query(_named("fuzzy", 0.5, "name ILIKE '%e_ro%'"))
def ast_fuzzy(spark, sf_dir):
    return shown(symbols.search(S.corpus(spark, sf_dir), "e_ro", limit=20))


@query(_named("fuzzy", 0.5, "name ILIKE '%cache%' AND type = 'method' AND language = 'typescript'"))
def ast_filters_combined(spark, sf_dir):
    return shown(symbols.search(S.corpus(spark, sf_dir), "cache", kind="method", language="typescript", limit=20))


AST_QUERY = "how does parseLedger keep_row the Session"
_symbols = U.symbol_names(AST_QUERY)
SQL_AST = (
    "w AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {quoted(s)})" for n, s in enumerate(_symbols)) + ") AS v(position, wanted)),"
    " h AS (SELECT position, id, row_number() OVER (PARTITION BY position ORDER BY name, line_start, id) AS nth FROM k JOIN w ON k.name ILIKE '%' || wanted || '%')"
)


@query(f"WITH {SQL_CORPUS}, {SQL_AST} SELECT id AS chunk_id, 0.5::DOUBLE AS score, (row_number() OVER (ORDER BY min(position * 1000 + nth)))::INTEGER AS rank FROM h WHERE nth <= 12 GROUP BY id")
def ast_symbols_dedup(spark, sf_dir):
    names = spark.createDataFrame([(0, n, s) for n, s in enumerate(_symbols)], "query_id long, position int, name string")
    return shown(symbols.batch(S.corpus(spark, sf_dir), names, 12))


# Paths.


def _globbed(glob, limit):
    return f"""WITH {SQL_FILES}, {SQL_CHUNKS}, g AS (SELECT c.id, c.file_id, c.line_start FROM c JOIN f ON f.id = c.file_id WHERE regexp_matches(path, {quoted(T.glob_pattern(glob))}))
        SELECT id AS chunk_id, 1.0::DOUBLE AS score, (row_number() OVER (ORDER BY file_id, line_start, id))::INTEGER AS rank FROM (SELECT * FROM g ORDER BY file_id, line_start, id LIMIT {limit})"""


@query(_globbed("*/mizormi/src/*.ts", 40))
def path_glob_star(spark, sf_dir):
    return shown(paths.by_glob(S.files(spark, sf_dir), S.chunks(spark, sf_dir), "*/mizormi/src/*.ts", 40))


@query(_globbed("**/src/**/*_?o*.py", 40))
def path_glob_globstar(spark, sf_dir):
    return shown(paths.by_glob(S.files(spark, sf_dir), S.chunks(spark, sf_dir), "**/src/**/*_?o*.py", 40))


def sql_path_score(path: str, term: str) -> str:
    parts = f"string_split(lower({path}), '/')"
    return f"""CASE WHEN list_contains(list_slice({parts}, 1, len({parts}) - 1), {term}) THEN 1.0e0
        WHEN regexp_replace({parts}[-1], '\\.[^.]+$', '') = {term} THEN 0.9e0 WHEN contains(lower({path}), {term}) THEN 0.7e0 ELSE 0e0 END"""


def sql_keywords(text: str, limit: int, only: str = "") -> str:
    best = "greatest(" + ", ".join(sql_path_score("path", quoted(w)) for w in text.lower().split() if len(w) >= 2) + ", 0e0)"
    return f"""
        ps{only} AS (SELECT id AS file_id, {best} AS score FROM f),
        pt{only} AS (SELECT c.id, c.file_id, ps.score, row_number() OVER (PARTITION BY c.file_id ORDER BY c.line_start, c.id) AS turn FROM c JOIN ps{only} ps ON ps.file_id = c.file_id WHERE ps.score > 0),
        path{only} AS (SELECT * FROM (SELECT id AS chunk_id, score, row_number() OVER (ORDER BY turn, score DESC, file_id) AS rank FROM pt{only}) WHERE rank <= {limit})"""


def _keywords(spark, sf_dir, text, limit):
    queries = spark.createDataFrame([(0, [w for w in text.lower().split() if len(w) >= 2])], "query_id long, terms array<string>")
    return paths.by_keywords(S.files(spark, sf_dir), S.chunks(spark, sf_dir), queries, limit)


@query(f"WITH {SQL_FILES}, best AS (SELECT id AS file_id, greatest({sql_path_score('path', quoted('index'))}, {sql_path_score('path', quoted('scripts'))}, {sql_path_score('path', quoted('cache'))}) AS score FROM f) SELECT * FROM best WHERE score > 0")
def path_keyword_tiers(spark, sf_dir):
    terms = F.array(*map(F.lit, ["index", "scripts", "cache"]))
    scored = S.files(spark, sf_dir).select(F.col("id").alias("file_id"), F.array_max(F.transform(terms, lambda t: paths.path_score(F.col("path"), t))).alias("score"))
    return scored.where("score > 0")


@query(f"WITH {SQL_FILES}, {SQL_CHUNKS}, {sql_keywords('scripts Cache x', 60)} SELECT chunk_id, score, rank::INTEGER AS rank FROM path")
def path_round_robin(spark, sf_dir):
    return shown(_keywords(spark, sf_dir, "scripts Cache x", 60))


# Understanding queries; the documents' titles and texts stand for questions.

SQL_QUESTIONS = "q AS (SELECT doc_id, coalesce(regexp_extract(text, '^[^\\n]*'), '') AS query FROM documents)"


def sql_kind(field: str) -> str:
    trimmed = f"regexp_replace({field}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"
    words = f"list_filter(string_split_regex(lower({trimmed}), '[ \\t\\r\\n\\f]+'), lambda w: w <> '')"
    listed = lambda ws: "[" + ", ".join(map(quoted, ws)) + "]"
    return f"""CASE WHEN regexp_matches({trimmed}, {quoted('(?i)' + V.PATH_QUERY)}) THEN 'path' WHEN regexp_matches({trimmed}, {quoted(V.SYMBOL_QUERY)}) THEN 'symbol'
        WHEN list_has_any({words}, {listed(V.QUESTION_WORDS)}) OR (len({words}) >= 4 AND list_has_any({words}, {listed(V.PHRASE_WORDS)})) THEN 'natural_language' ELSE 'keyword' END"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_extract("text", r"^[^\n]*", 0), F.lit("")).alias("query"))


@query(f"WITH {SQL_QUESTIONS} SELECT doc_id, {sql_kind('query')} AS kind FROM q")
def classify_queries(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", U.classified(F.col("query")).alias("kind"))


def sql_weight(strategy: str) -> str:
    base = V.STRATEGY_WEIGHTS[strategy]
    return "CASE kind " + " ".join(f"WHEN {quoted(k)} THEN {base * m.get(strategy, 1.0)!r}e0" for k, m in V.MULTIPLIERS.items()) + f" END AS {strategy}"


@query(f"WITH {SQL_QUESTIONS}, kinds AS (SELECT doc_id, {sql_kind('query')} AS kind FROM q) SELECT doc_id, {', '.join(map(sql_weight, V.STRATEGY_WEIGHTS))} FROM kinds")
def effective_weights(spark, sf_dir):
    kinds = _questions(spark, sf_dir).select("doc_id", U.classified(F.col("query")).alias("kind"))
    return kinds.select("doc_id", *[U.weight(F.col("kind"), s).alias(s) for s in V.STRATEGY_WEIGHTS])


@query(f"WITH {SQL_QUESTIONS} SELECT doc_id, list_filter(string_split_regex(query, '[ \\t\\r\\n\\f]+'), lambda t: length(t) >= 2) AS terms FROM q")
def boost_terms(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", fusion.boost_terms(F.col("query")).alias("terms"))


SQL_LINE = "trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g'))"


@query(f"WITH {SQL_CHUNKS} SELECT id, [line_start, line_end] AS lines, CASE WHEN length({SQL_LINE}) <= 200 THEN {SQL_LINE} ELSE substr({SQL_LINE}, 1, 200) || '...' END AS snippet FROM c")
def output_snippet(spark, sf_dir):
    return S.chunks(spark, sf_dir).select("id", F.array("line_start", "line_end").alias("lines"), T.snippet("text").alias("snippet"))


# Fusion.  Lists: the chunks of functions by name, and those of typed constants and methods by line.

SQL_LISTS = """l AS (
    SELECT 0 AS position, {w0}e0 AS weight, id AS chunk_id, row_number() OVER (ORDER BY name, id) AS rank FROM c WHERE type = 'function' AND name IS NOT NULL
    UNION ALL SELECT 1, {w1}e0, id, row_number() OVER (ORDER BY line_start DESC, id) FROM c WHERE type IN ('function', 'method'))"""
SQL_FUSED = """e AS (SELECT chunk_id, list_reduce(list(weight * (1 / (60e0 + rank)) ORDER BY position, rank), lambda a, b: a + b) AS raw, min(position * 100000000 + rank) AS first FROM l GROUP BY chunk_id),
    z AS (SELECT chunk_id, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END AS score, row_number() OVER (ORDER BY raw DESC, first, chunk_id) AS place FROM e)"""


def _lists(spark, sf_dir, w0, w1):
    rows = S.chunks(spark, sf_dir)
    first = rows.where("type = 'function' and name is not null").select(F.lit(0).alias("position"), F.lit(w0).alias("weight"), F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy("name", "id")).alias("rank"))
    second = rows.where("type in ('function', 'method')").select(F.lit(1).alias("position"), F.lit(w1).alias("weight"), F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc("line_start"), "id")).alias("rank"))
    return first.unionByName(second).withColumn("query_id", F.lit(0).cast("long"))


def _fused(spark, sf_dir, w0, w1):
    found = fusion.fused(_lists(spark, sf_dir, w0, w1), 100)
    return found.select("chunk_id", F.round("score", 6).alias("score"), F.col("place").cast("int").alias("place"))


def _sql_fused(w0, w1):
    return f"WITH {SQL_CHUNKS}, {SQL_LISTS.format(w0=w0, w1=w1)}, {SQL_FUSED} SELECT chunk_id, round(score, 6) AS score, place::INTEGER AS place FROM z WHERE place <= 100"


@query(_sql_fused(1.0, 1.0))
def rrf_two_lists(spark, sf_dir):
    return _fused(spark, sf_dir, 1.0, 1.0)


@query(_sql_fused(0.8, 1.35))
def rrf_weighted(spark, sf_dir):
    return _fused(spark, sf_dir, 0.8, 1.35)


@query(_sql_fused(0.9, 0.0))
def rrf_zero_weight(spark, sf_dir):
    return _fused(spark, sf_dir, 0.9, 0.0)


# Re-ranking.


def sql_boost(path: str, terms: list[str]) -> str:
    if not terms:
        return "1e0"
    parts = f"string_split(lower({path}), '/')"
    one = lambda t: f"CASE WHEN list_contains(list_slice({parts}, 1, len({parts}) - 1), {t}) THEN 1.5e0 WHEN regexp_replace({parts}[-1], '\\.[^.]+$', '') = {t} THEN 1.4e0 WHEN contains(lower({path}), {t}) THEN 1.2e0 ELSE 1e0 END"
    return "greatest(1e0, " + ", ".join(one(quoted(t.lower())) for t in terms) + ")"


SQL_IS_TEST = f"regexp_matches(replace(lower(path), '\\', '/'), {quoted(V.TEST_PATH)})"
SQL_IS_SMALL = "greatest(1, line_end - line_start + 1) <= 3"
SQL_IS_PUBLIC = "(coalesce(exports, false) OR starts_with(lower(ltrim(regexp_replace(text, '^[ \\t\\r\\n\\f]+', ''))), 'export '))"
_lines = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')), lambda x: x <> '')"
_pairs = f"len(list_filter({_lines}, lambda x: regexp_matches(x, '[''\"`]?[A-Za-z0-9_-]+[''\"`]?[ \\t]*:')))"
SQL_IS_LITERAL = f"""(type = 'constant' AND ((contains(text, '{{') AND contains(text, '}}')) OR (contains(text, '[') AND contains(text, ']'))) AND {_pairs} >= 2
    AND {_pairs} / greatest(len({_lines}), 1)::DOUBLE >= 0.35e0 AND length(regexp_replace(text, '[^"''`:]', '', 'g')) / greatest(length(regexp_replace(text, '[ \\t\\r\\n\\f]+', '', 'g')), 1)::DOUBLE >= 0.04e0)"""


def sql_reranked(terms: list[str], limit: int, only: str = "", source: str = "z") -> str:
    """CTEs ending in ``best(chunk_id, path, type, score, place)`` from ``z(chunk_id, score, place)`` and ``k``."""
    return f"""
        x{only} AS (SELECT z.chunk_id, z.score, z.place, k.path, k.type, {sql_boost('path', terms)} AS boost, {SQL_IS_PUBLIC} AS public,
            coalesce(type = 'import', false) AS i, coalesce({SQL_IS_TEST}, false) AS t, coalesce({SQL_IS_SMALL}, false) AS s, coalesce({SQL_IS_LITERAL}, false) AS d
            FROM {source} z JOIN k ON k.id = z.chunk_id),
        y{only} AS (SELECT chunk_id, path, type, place, score * boost * CASE WHEN i AND coalesce(max(score) FILTER (NOT i) OVER () > 0, false) THEN 0.5e0 ELSE 1e0 END * CASE WHEN t AND coalesce(max(score) FILTER (NOT t) OVER () > 0, false) THEN 0.65e0 ELSE 1e0 END
            * CASE WHEN s AND coalesce(max(score) FILTER (NOT s) OVER () > 0, false) THEN 0.75e0 ELSE 1e0 END * CASE WHEN d AND coalesce(max(score) FILTER (NOT d) OVER () > 0, false) THEN 0.7e0 ELSE 1e0 END * CASE WHEN public THEN 1.12e0 ELSE 1e0 END AS score FROM x{only}),
        v{only} AS (SELECT chunk_id, path, type, row_number() OVER (ORDER BY score DESC, place) AS second,
            score * CASE row_number() OVER (PARTITION BY path ORDER BY score DESC, place) WHEN 1 THEN 1e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 0.8e0 ELSE 0.7e0 END AS score FROM y{only}),
        b{only} AS (SELECT *, row_number() OVER (ORDER BY score DESC, second) AS place FROM v{only}),
        best{only} AS (SELECT chunk_id, path, type, score / max(score) OVER () AS score, place FROM b{only} WHERE place <= {limit})"""


def _reranked(spark, sf_dir, lists, terms, limit, fetch):
    queries = spark.createDataFrame([(0, terms)], "query_id long, terms array<string>")
    best = fusion.reranked(fusion.fused(lists, fetch), S.corpus(spark, sf_dir), queries, limit)
    return best.select("chunk_id", "path", F.round("score", 6).alias("score"), F.col("place").cast("int").alias("place"))


def _sql_rerank(lists, terms, limit, fetch):
    return f"WITH {SQL_CORPUS}, {lists}, {SQL_FUSED.replace('FROM e)', 'FROM e QUALIFY place <= ' + str(fetch) + ')')}, {sql_reranked(terms, limit)} SELECT chunk_id, path, round(score, 6) AS score, place::INTEGER AS place FROM best"


_two = SQL_LISTS.format(w0=1.0, w1=1.0)


@query(_sql_rerank(_two, ["src", "index", "Cache"], 50, 150))
def rerank_path_boost(spark, sf_dir):
    return _reranked(spark, sf_dir, _lists(spark, sf_dir, 1.0, 1.0), ["src", "index", "Cache"], 50, 150)


SQL_ALL = "l AS (SELECT 0 AS position, 1e0 AS weight, id AS chunk_id, row_number() OVER (ORDER BY line_start, id) AS rank FROM k)"


def _all(spark, sf_dir):
    rows = S.corpus(spark, sf_dir)
    return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("position"), F.lit(1.0).alias("weight"), F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy("line_start", "id")).alias("rank"))


@query(_sql_rerank(SQL_ALL, [], 300, 900))
def rerank_penalties(spark, sf_dir):
    return _reranked(spark, sf_dir, _all(spark, sf_dir), [], 300, 900)


@query(f"WITH {SQL_CORPUS} SELECT id, {SQL_IS_PUBLIC} AS public, {SQL_IS_TEST} AS test, {SQL_IS_SMALL} AS small, coalesce({SQL_IS_LITERAL}, false) AS literal FROM k")
def rerank_public_api(spark, sf_dir):
    path, text = F.col("path"), F.col("text")
    kinds = [fusion.is_public(F.col("exports"), text).alias("public"), fusion.is_test_path(path).alias("test"), fusion.is_small(F.col("line_start"), F.col("line_end")).alias("small")]
    return S.corpus(spark, sf_dir).select("id", *kinds, F.coalesce(fusion.is_data_literal(F.col("type"), text), F.lit(False)).alias("literal"))


@query(
    """SELECT l_orderkey, l_linenumber, nth::INTEGER AS nth, round(l_quantity * CASE nth WHEN 1 THEN 1e0 WHEN 2 THEN 0.9e0 WHEN 3 THEN 0.8e0 ELSE 0.7e0 END, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS nth FROM lineitem)"""
)
def rerank_file_diversity(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", nth.alias("nth"))
    first, second, third, rest = V.FILE_FACTORS
    factor = F.when(F.col("nth") == 1, first).when(F.col("nth") == 2, second).when(F.col("nth") == 3, third).otherwise(rest)
    return rows.select("l_orderkey", "l_linenumber", F.col("nth").cast("int").alias("nth"), F.round(F.col("l_quantity") * factor, 6).alias("score"))


HYBRID = {1: "session cache", 2: "how does the ledger keep a row in order", 3: "parseLedger", 4: "mizormi/src/**/*cache*.ts"}


def _sql_hybrid(limit: int = 10) -> str:
    out, tails = [SQL_CORPUS], []
    for q, text in HYBRID.items():
        by, strategies, lists = U.weights_of(text), U.strategies_for(text, ["fts", "ast", "path"]), []
        wide = limit * 3
        for position, s in enumerate(strategies):
            name = f"_{q}"
            if s == "fts":
                out.append(sql_fulltext(text, wide, only=name))
                lists.append((position, by[s], f"SELECT chunk_id, rank FROM fts{name}"))
            elif s == "ast":
                values = ", ".join(f"({n}, {quoted(x)})" for n, x in enumerate(U.symbol_names(text)))
                out.append(f"w{name} AS (SELECT * FROM (VALUES {values}) AS v(position, wanted)), h{name} AS (SELECT position, id, row_number() OVER (PARTITION BY position ORDER BY name, line_start, id) AS nth FROM k JOIN w{name} ON k.name ILIKE '%' || wanted || '%')")
                lists.append((position, by[s], f"SELECT id AS chunk_id, row_number() OVER (ORDER BY min(position * 1000 + nth)) AS rank FROM h{name} WHERE nth <= {wide} GROUP BY id"))
            elif U.is_path_like(text):
                out.append(f"pg{name} AS (SELECT id AS chunk_id, row_number() OVER (ORDER BY file_id, line_start, id) AS rank FROM k WHERE regexp_matches(path, {quoted(T.glob_pattern(text))}))")
                lists.append((position, by[s], f"SELECT chunk_id, rank FROM pg{name} WHERE rank <= {wide}"))
            else:
                out.append(sql_keywords(text, wide, only=name))
                lists.append((position, by[s], f"SELECT chunk_id, rank FROM path{name}"))
        union = " UNION ALL ".join(f"SELECT {p} AS position, {w!r}e0 AS weight, chunk_id, rank FROM ({s})" for p, w, s in lists)
        fused = SQL_FUSED.replace("FROM e)", f"FROM e QUALIFY place <= {wide})").replace("e AS", f"e_{q} AS").replace("FROM l ", f"FROM l_{q} ").replace("z AS", f"z_{q} AS").replace("FROM e QUALIFY", f"FROM e_{q} QUALIFY")
        out += [f"l_{q} AS ({union})", fused, sql_reranked([w for w in text.split() if len(w) >= 2], limit, only=f"_{q}", source=f"z_{q}")]
        tails.append(f"SELECT {q}::BIGINT AS query_id, place::INTEGER AS place, chunk_id, path, type, round(score, 6) AS score FROM best_{q}")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(tails)


@query(_sql_hybrid())
def hybrid_search_flagship(spark, sf_dir):
    found = hybrid.search(S.corpus(spark, sf_dir), S.files(spark, sf_dir), HYBRID, 10, asked=["fts", "ast", "path"])
    return found.select("query_id", F.col("place").cast("int").alias("place"), "chunk_id", "path", "type", F.round("score", 6).alias("score"))


# Chunks.

SQL_WORDS = "len(list_filter(string_split_regex({0}, '[ \\t\\r\\n\\f\\x0b]+'), lambda w: w <> ''))"


@query(f"WITH {SQL_CHUNKS} SELECT id, ceil({SQL_WORDS.format('text')} * 1.3::DOUBLE)::BIGINT AS tokens FROM c")
def token_estimate(spark, sf_dir):
    return S.chunks(spark, sf_dir).select("id", T.token_estimate("text").alias("tokens"))


@query(
    f"""WITH RECURSIVE {SQL_CHUNKS}, big AS (SELECT id, line_start, list_transform(string_split(text, chr(10)), lambda x: {SQL_WORDS.format('x')}) AS n FROM c WHERE ceil({SQL_WORDS.format('text')} * 1.3::DOUBLE) > 100),
    go AS (SELECT id, line_start, n, 1 AS nth, 0 AS lo, 0::BIGINT AS held, 0 AS piece, false AS cut, 0 AS prior FROM big
        UNION ALL
        SELECT id, line_start, n, nth + 1, CASE WHEN brim THEN nth - 1 ELSE lo END, CASE WHEN brim THEN n[nth] ELSE held + n[nth] END, piece + brim::INTEGER, brim, CASE WHEN brim THEN lo ELSE prior END
        FROM (SELECT *, ceil((held + n[nth]) * 1.3::DOUBLE) >= 100 AND nth - 1 > lo AS brim FROM go) AS stepped WHERE nth <= len(n)),
    done AS (SELECT id, piece - 1 AS piece, line_start + prior AS line_start, line_start + lo - 1 AS line_end FROM go WHERE cut
        UNION ALL SELECT id, piece, line_start + lo, line_start + len(n) - 1 FROM go WHERE nth = len(n) + 1)
    SELECT id, piece::INTEGER AS piece, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end FROM done"""
)
def chunk_split(spark, sf_dir):
    large = S.chunks(spark, sf_dir).where(T.token_estimate("text") > 100).select("id", "line_start", "line_end", "text")
    return chunking.split_large(large, most=100).select("id", "piece", "line_start", "line_end")


@query()
def chunk_files(spark, sf_dir):
    """All chunks built anew from the parsed nodes."""
    nodes = table(spark, sf_dir, "ast_nodes").dropDuplicates(["node_id"])
    owners = S.files(spark, sf_dir).select(F.col("id").alias("file_id"), "path")
    return chunking.chunked(nodes.join(owners, "file_id").select("node_id", "file_id", "path", "type", "name", "parent", "line_start", "line_end", "text", "exports")).select("file_id", "line_start", "line_end", "type", "name", "id", "hash")


@query(
    f"""WITH RECURSIVE {SQL_CHUNKS}, s AS (SELECT file_id, line_start, line_end, ceil({SQL_WORDS.format('text')} * 1.3::DOUBLE)::BIGINT AS n, {SQL_WORDS.format('text')} AS w, row_number() OVER (PARTITION BY file_id ORDER BY line_start, id) AS nth FROM c WHERE type = 'constant'),
    go AS (SELECT file_id, nth, line_start AS lo, line_end, n, w, n < 50 AS held, 1 AS piece FROM s WHERE nth = 1
        UNION ALL
        SELECT file_id, nth, CASE WHEN joins THEN lo ELSE line_start END, line_end, CASE WHEN joins THEN ceil((w0 + w) * 1.3::DOUBLE)::BIGINT ELSE n END, CASE WHEN joins THEN w0 + w ELSE w END, n < 50, piece + (NOT joins)::INTEGER
        FROM (SELECT s.*, go.lo, go.w AS w0, go.piece, go.held AND s.n < 50 AND go.n + s.n <= 100 AS joins FROM go JOIN s ON s.file_id = go.file_id AND s.nth = go.nth + 1) AS stepped)
    SELECT file_id, piece::INTEGER AS piece, min(lo)::INTEGER AS line_start, arg_max(line_end, nth)::INTEGER AS line_end, count(*) AS merged FROM go GROUP BY file_id, piece"""
)
def chunk_merge_small(spark, sf_dir):
    """Constants merged to at most 100 tokens; ``merged`` counts them by the mark put behind each text."""
    one = F.struct("line_start", "line_end", "type", "name", "parent", F.concat("text", F.lit("\u0001")).alias("text"), T.token_estimate("text").alias("tokens"), "exports", F.array(F.lit("")).alias("imports")).cast(chunking.CHUNK)
    rows = S.chunks(spark, sf_dir).where("type = 'constant'").groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "id", one.alias("c")))), lambda x: x["c"]).alias("chunks"))
    merged = rows.select("file_id", F.posexplode(chunking.merged_constants(F.col("chunks"), 100)).alias("piece", "c"))
    marks = F.length("c.text") - F.length(F.replace("c.text", F.lit("\u0001"), F.lit("")))
    return merged.select("file_id", (F.col("piece") + 1).alias("piece"), F.col("c.line_start").alias("line_start"), F.col("c.line_end").alias("line_end"), marks.cast("long").alias("merged"))


@query(f"WITH {SQL_CORPUS} SELECT id, substr(sha256(path || ':' || line_start || ':' || line_end), 1, 16) AS chunk_key, substr(sha256(text), 1, 16) AS hash FROM k")
def chunk_ids(spark, sf_dir):
    return S.corpus(spark, sf_dir).select("id", T.chunk_id("path", "line_start", "line_end").alias("chunk_key"), T.short_hash("text").alias("hash"))


SQL_NODES = "a AS (SELECT DISTINCT node_id, file_id, type, name, parent, line_start, line_end, text FROM ast_nodes)"


@query(f"WITH {SQL_NODES} SELECT file_id, min(line_start)::INTEGER AS line_start, arg_max(line_end, line_start * 10000000000 + node_id)::INTEGER AS line_end, string_agg(coalesce(text, ''), chr(10) ORDER BY line_start, node_id) AS text FROM a WHERE type = 'import' GROUP BY file_id")
def import_grouping(spark, sf_dir):
    nodes = table(spark, sf_dir, "ast_nodes").select("node_id", "file_id", "type", "line_start", "line_end", "text").dropDuplicates(["node_id"])
    return chunking.grouped_imports(nodes)


@query(f"WITH {SQL_NODES} SELECT node_id, type, name FROM a WHERE type IS NULL OR type <> 'class' OR NOT EXISTS (SELECT 1 FROM a m WHERE m.type = 'method' AND m.file_id = a.file_id AND m.parent = a.name)")
def class_with_methods_antijoin(spark, sf_dir):
    nodes = table(spark, sf_dir, "ast_nodes").select("node_id", "file_id", "type", "name", "parent").dropDuplicates(["node_id"])
    return chunking.without_split_classes(nodes).select("node_id", "type", "name")


# Changes and the store.  The stored side: no file of every tenth id, another hash for every seventh, one that is gone.

SQL_STORED = f"{SQL_FILES}, old AS (SELECT id, path, language, CASE WHEN id % 7 = 0 THEN 'old' ELSE hash END AS hash, size FROM f WHERE id % 10 <> 0 UNION ALL SELECT 900000001, 'gone/file.ts', 'typescript', 'x', 1)"


def _stored(spark, sf_dir):
    kept = S.files(spark, sf_dir).where("id % 10 <> 0").select("id", "path", "language", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.col("size").cast("long").alias("size"))
    return kept.unionByName(spark.createDataFrame([(900000001, "gone/file.ts", "typescript", "x", 1)], "id long, path string, language string, hash string, size long"))


@query(
    f"""WITH {SQL_STORED} SELECT coalesce(f.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' WHEN f.hash IS NOT DISTINCT FROM old.hash THEN 'unchanged' ELSE 'modified' END AS status, f.hash AS hash
    FROM f FULL JOIN old ON f.path = old.path"""
)
def diff_changes(spark, sf_dir):
    return changes.compared(S.files(spark, sf_dir), _stored(spark, sf_dir))


@query(f"WITH {SQL_STORED} SELECT id, path FROM old WHERE EXISTS (SELECT 1 FROM f WHERE f.path = old.path AND f.hash = old.hash)")
def hash_match_semi(spark, sf_dir):
    return changes.matching(_stored(spark, sf_dir), S.files(spark, sf_dir)).select("id", "path")


@query(f"WITH {SQL_CHUNKS}, {SQL_VECTORS} SELECT id FROM c WHERE id NOT IN (SELECT chunk_id FROM u)")
def missing_vectors_antijoin(spark, sf_dir):
    return changes.missing_vectors(S.chunks(spark, sf_dir), S.usable_vectors(spark, sf_dir)).select("id")


@query(
    f"""WITH {SQL_STORED}, new AS (SELECT path, language, hash, size FROM f WHERE id % 3 <> 1), top AS (SELECT max(id) AS t FROM old)
    SELECT id, path, language, hash FROM old WHERE path NOT IN (SELECT path FROM new)
    UNION ALL SELECT old.id, new.path, new.language, new.hash FROM new JOIN old ON old.path = new.path
    UNION ALL SELECT t + row_number() OVER (ORDER BY path), path, language, hash FROM new, top WHERE path NOT IN (SELECT path FROM old)"""
)
def upsert_files(spark, sf_dir):
    new = S.files(spark, sf_dir).where("id % 3 <> 1").select("path", "language", "hash", F.col("size").cast("long").alias("size"))
    return changes.upserted(_stored(spark, sf_dir), new).drop("size")


@query(
    f"""WITH {SQL_FILES}, {SQL_CHUNKS}, {SQL_VECTORS}, lost AS (SELECT id FROM f WHERE contains(path, '/src/'))
    SELECT 'files' AS what, count(*) AS n FROM f WHERE id NOT IN (SELECT id FROM lost) UNION ALL SELECT 'chunks', count(*) FROM c WHERE file_id NOT IN (SELECT id FROM lost)
    UNION ALL SELECT 'vectors', count(*) FROM u WHERE chunk_id NOT IN (SELECT id FROM c WHERE file_id IN (SELECT id FROM lost))"""
)
def cascade_delete(spark, sf_dir):
    rows, pieces, stored = S.files(spark, sf_dir), S.chunks(spark, sf_dir), S.usable_vectors(spark, sf_dir)
    left = changes.without_files(rows, pieces, stored, rows.where(F.contains("path", F.lit("/src/"))).select("path"))
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, d in zip(("files", "chunks", "vectors"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {SQL_FILES}, {SQL_CHUNKS}, {SQL_VECTORS} SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM u) AS vectors")
def status_counts(spark, sf_dir):
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return count(S.files(spark, sf_dir), "files").join(F.broadcast(count(S.chunks(spark, sf_dir), "chunks"))).join(F.broadcast(count(S.usable_vectors(spark, sf_dir), "vectors")))


@query(f"WITH {SQL_FILES} SELECT language, count(*) AS files FROM f GROUP BY language")
def language_breakdown(spark, sf_dir):
    return S.files(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT max(last_indexed) AS last_indexed FROM files")
def last_indexed(spark, sf_dir):
    return table(spark, sf_dir, "files").agg(F.max("last_indexed").alias("last_indexed"))


# The dependency graph, from the chunks of the five targets with the most edges and five sources.

SQL_EDGES = "g AS (SELECT DISTINCT source_chunk_id AS src, target_chunk_id AS dst FROM dependencies WHERE source_chunk_id <> target_chunk_id)"


def _sql_trace(here, there):
    return f"""WITH RECURSIVE {SQL_EDGES}, starts AS (SELECT {here} AS node FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
        walk(start, node, depth) AS (SELECT node, node, 0 FROM starts UNION SELECT start, g.{there}, depth + 1 FROM walk JOIN g ON g.{here} = walk.node WHERE depth < 3)
        SELECT start, node AS chunk_id, min(depth)::INTEGER AS depth, round(1.0e0 - 0.2e0 * (min(depth) - 1), 6) AS score FROM walk WHERE node <> start GROUP BY start, node"""


def _traced(spark, sf_dir, here, direction):
    edges = S.edges(spark, sf_dir).select("src", "dst").distinct()
    starts = edges.groupBy(here).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), here).limit(5).select(F.col(here).alias("start"))
    return graph.trace(edges, starts, direction, 3).select("start", "chunk_id", "depth", F.round("score", 6).alias("score"))


@query(_sql_trace("src", "dst"))
def deps_bfs_imports(spark, sf_dir):
    return _traced(spark, sf_dir, "src", "imports")


@query(_sql_trace("dst", "src"))
def deps_bfs_imported_by(spark, sf_dir):
    return _traced(spark, sf_dir, "dst", "importedBy")


@query("SELECT source_chunk_id AS src, target_chunk_id AS dst, lower(trim(type)) AS type FROM dependencies WHERE source_chunk_id <> target_chunk_id GROUP BY ALL")
def dependency_edges(spark, sf_dir):
    return S.edges(spark, sf_dir)


# Questions to terms and plans.

QUESTIONS = ("How does the authentication handler work?", "where is fs.readFileSync used", "list src/search/path.ts, please!", "the", "indexing of createPool and AUTH_SECRET", "what is it")


@query()
def search_terms(spark, sf_dir):
    return spark.createDataFrame([(q, U.search_terms(q)) for q in QUESTIONS], "question string, terms string")


@query()
def fallback_plan(spark, sf_dir):
    rows = [(q, s["strategy"], s["query"], float(s["weight"])) for q in QUESTIONS for s in U.fallback_plan(q)]
    return spark.createDataFrame(rows, "question string, strategy string, query string, weight double")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_plan_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# The stream of changes.

SQL_FEED = "n AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, path, type, ts FROM file_changes WHERE path IS NOT NULL AND ts IS NOT NULL)"


def _feed(spark, sf_dir):
    rows = table(spark, sf_dir, "file_changes").where("path is not null and ts is not null")
    return rows.select(F.split("path", "/")[0].alias("repo"), "path", "type", "ts").distinct()


@query(
    f"""WITH {SQL_FEED}, o AS (SELECT *, lag(ts) OVER (PARTITION BY repo ORDER BY ts, path, type) AS p FROM n),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY ts, path, type ROWS UNBOUNDED PRECEDING) AS session FROM o)
    SELECT repo, session::BIGINT AS session, path, arg_max(type, epoch_us(ts) * 10 + CASE type WHEN 'add' THEN 0 WHEN 'change' THEN 1 ELSE 2 END) AS type, min(ts) AS first_seen FROM s GROUP BY repo, session, path"""
)
def debounce_sessions(spark, sf_dir):
    found = changes.latest_changes(_feed(spark, sf_dir), gap_seconds=600.0)
    return found.select("repo", F.col("session").cast("long").alias("session"), "path", "type", "first_seen")


@query(
    f"""WITH {SQL_FEED} SELECT path, type, ts FROM n WHERE regexp_matches(lower(regexp_extract(path, '[^/]+$')), '^.+({'|'.join(e.replace('.', '[.]') for e in V.LANGUAGES)})$')
    AND NOT list_has_any(string_split(path, '/'), [{', '.join(map(quoted, V.UNWATCHED_FOLDERS))}])"""
)
def watch_ignore_filter(spark, sf_dir):
    from seekspark.streaming.watch import watched

    return _feed(spark, sf_dir).where(watched(F.col("path"))).select("path", "type", "ts")


@query()
def watch_stream_available_now(spark, sf_dir):
    """The same feed read as a stream until it ends; sessions still open then are not given."""
    from seekspark.streaming.watch import drained

    return drained(spark, f"{sf_dir}/file_changes.parquet", gap="10 minutes")


# Discovery.

SQL_EXTENSION = "CASE WHEN regexp_matches(string_split(path, '/')[-1], '^\\.[^.]*$') THEN string_split(path, '/')[-1] ELSE lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1)) END"


@query(f"WITH {SQL_FILES} SELECT id, CASE {SQL_EXTENSION} {' '.join(f'WHEN {quoted(e)} THEN {quoted(v)}' for e, v in V.LANGUAGES.items())} END AS language FROM f")
def discover_language_map(spark, sf_dir):
    return S.files(spark, sf_dir).select("id", T.language_of("path").alias("language"))


@query(f"WITH {SQL_FILES} SELECT id, path FROM f WHERE NOT regexp_matches(path, {quoted(T.ignore_pattern(V.IGNORED))})")
def discover_ignore(spark, sf_dir):
    return S.files(spark, sf_dir).where(~F.col("path").rlike(T.ignore_pattern(V.IGNORED))).select("id", "path")


@query(f"WITH {SQL_CORPUS} SELECT id, concat_ws(chr(10), path, nullif(parent, ''), text) AS prepared FROM k")
def embed_text_prepare(spark, sf_dir):
    return S.corpus(spark, sf_dir).select("id", prepared("path", "parent", "text").alias("prepared"))
