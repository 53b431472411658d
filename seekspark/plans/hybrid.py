"""The hybrid search: strategies per query, fused and re-ranked, for a bounded batch of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.functions.text import snippet
from seekspark.operators import fulltext, fusion, paths, symbols, vectors
from seekspark.plans import understanding as U
from seekspark.shared import cut

BATCH_QUERIES = 1000


def ranked_lists(corpus: DataFrame, files: DataFrame, plans: dict[int, list[dict]], limit: int, stored: DataFrame | None = None, embed: Callable | None = None, language: str | None = None, postings: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, position, weight, chunk_id, rank) of every strategy of every query's plan.

    A plan is a list of {strategy, query, weight}; ``position`` is its place there.  ``stored`` is (chunk_id, vector)
    and ``embed`` gives the vector of a text; without them the strategy vector gives nothing, as dependency always does.
    """
    if len(plans) > BATCH_QUERIES:
        raise ValueError(f"a batch holds at most {BATCH_QUERIES} queries")
    spark = corpus.sparkSession
    steps = {(q, p): s for q, plan in plans.items() for p, s in enumerate(plan)}
    number = {at: n for n, at in enumerate(steps)}
    of = lambda name: {number[at]: s["query"] for at, s in steps.items() if s["strategy"] == name and s["query"].strip()}
    lists = []
    words = {n: t for n, t in of("fts").items() if fulltext.sanitise(t)}
    if words:
        lists.append(fulltext.search(corpus, words, limit, language, stored=postings))
    names = [(n, p, name) for n, t in of("ast").items() for p, name in enumerate(U.symbol_names(t))]
    if names:
        lists.append(symbols.batch(corpus, spark.createDataFrame(names, "query_id long, position int, name string"), limit, language))
    by_path = of("path")
    for n, text in by_path.items():
        if U.is_path_like(text):
            lists.append(paths.by_glob(files, corpus, text, limit).withColumn("query_id", F.lit(n).cast("long")))
    keywords = [(n, [w for w in t.lower().split() if len(w) >= 2]) for n, t in by_path.items() if not U.is_path_like(t)]
    if any(w for _, w in keywords):
        lists.append(paths.by_keywords(files, corpus, spark.createDataFrame(keywords, "query_id long, terms array<string>"), limit))
    questions = [(n, embed(t)) for n, t in of("vector").items()] if embed and stored is not None else []
    if questions:
        wide = vectors.nearest(stored, questions, limit * 3 if language else limit)
        if language:
            wide = wide.join(corpus.where(F.col("language") == language).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
            wide = wide.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= limit)
        lists.append(wide)
    places = spark.createDataFrame([(n, q, p, float(steps[q, p]["weight"])) for (q, p), n in number.items()], "n long, query_id long, position int, weight double")
    columns = [F.col("query_id").cast("long").alias("n"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("rank").cast("int").alias("rank")]
    if not lists:
        return spark.createDataFrame([], "query_id long, position int, weight double, chunk_id long, rank int")
    every = reduce(DataFrame.unionByName, [x.select(*columns) for x in lists])
    return every.join(F.broadcast(places), "n").select("query_id", "position", "weight", "chunk_id", "rank")


def search(corpus: DataFrame, files: DataFrame, queries: dict[int, str], limit: int = 10, asked: list[str] | None = None, plans: dict[int, list[dict]] | None = None, **options) -> DataFrame:
    """(query_id, place, chunk_id, path, line_start, line_end, name, type, language, score, text) of the best rows.

    Without ``plans`` each query runs the strategies for its class, at weights by its class; each fetches three times
    the limit.  Words of the query itself boost paths.
    """
    limit = U.whole_limit(limit)
    if plans is None:
        plans = {q: [{"strategy": s, "query": t, "weight": U.weights_of(t)[s]} for s in U.strategies_for(t, asked)] for q, t in queries.items()}
    spark = corpus.sparkSession
    lists = cut(ranked_lists(corpus, files, plans, limit * 3, **options))
    terms = spark.createDataFrame([(q, [w for w in t.split() if len(w) >= 2]) for q, t in queries.items()], "query_id long, terms array<string>")
    # A batch has at most BATCH_QUERIES queries of 3 x limit rows, which is small enough to be sent to the chunks.
    kept = fusion.fused(lists, limit * 3)
    best = fusion.reranked(F.broadcast(kept) if limit <= 100 else kept, corpus, F.broadcast(terms), limit)
    rows = corpus.select(F.col("id").alias("chunk_id"), "line_start", "line_end", "name", "language", "text")
    return rows.join(F.broadcast(best) if limit <= 100 else best, "chunk_id").select("query_id", "place", "chunk_id", "path", "line_start", "line_end", "name", "type", "language", "score", "text")


def output(results: DataFrame) -> DataFrame:
    """The rows of a search as they are shown: two decimals, one line of text."""
    return results.select(
        "query_id", "place", F.col("path").alias("file"), F.array("line_start", "line_end").alias("lines"), "name", "type",
        (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"), snippet("text").alias("snippet"), "language",
    )


def as_json(results: DataFrame) -> DataFrame:
    shown = output(results)
    return shown.select("query_id", "place", F.to_json(F.struct(*[c for c in shown.columns if c not in ("query_id", "place")])).alias("json"))


def as_text(query: str, rows: list) -> str:
    """Collected output rows of one query as text for a terminal."""
    if not rows:
        return f'No results for "{query}"'
    out = [f'Results for "{query}":', ""]
    for r in rows:
        label = f"{r.name} [{r.type}]" if r.name else f"[{r.type}]"
        out += [f"{r.place}. {r.file}:{r.lines[0]}-{r.lines[1]} (score: {r.score:g})", f"   {label}", f"   {r.snippet}", ""]
    return "\n".join(out)
