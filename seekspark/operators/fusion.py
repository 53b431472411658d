"""Weighted reciprocal rank fusion and re-ranking, for all queries of a batch in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.functions.text import bare_name, folders


def fused(lists: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, score, place) of (query_id, position, weight, chunk_id, rank).

    ``position`` numbers the lists of a query, so that one strategy may come twice.  Each list adds
    weight / (60 + rank); ties keep the order in which lists and ranks first named a chunk; the best has score 1.
    """
    one = F.struct("position", "rank", (F.col("weight") * (1 / (V.RRF_K + F.col("rank")))).alias("part"))
    grouped = lists.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(one)).alias("parts"))
    summed = grouped.select("query_id", "chunk_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("raw"), F.element_at("parts", 1).alias("first"))
    summed = summed.select("query_id", "chunk_id", "raw", "first.position", "first.rank")
    of_query = Window.partitionBy("query_id")
    place = F.row_number().over(of_query.orderBy(F.desc("raw"), "position", "rank", "chunk_id"))
    best = F.first("raw").over(of_query.orderBy(F.desc("raw"), "position", "rank", "chunk_id"))
    score = F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(0.0)
    placed = summed.withColumn("place", place).withColumn("best", best).where(F.col("place") <= limit)
    return placed.select("query_id", "chunk_id", score.alias("score"), "place")


def path_boost(path, terms) -> Column:
    """The largest factor any term earns: a folder of that name, the file's bare name, or anywhere in the path."""
    lower = F.lower(path)
    steps = V.PATH_BOOST

    def factor(term):
        t = F.lower(term)
        return F.when(F.array_contains(folders(lower), t), steps["directory"]).when(bare_name(lower) == t, steps["filename"]).when(F.contains(lower, t), steps["partial"]).otherwise(1.0)

    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(terms, factor)), F.lit(1.0)))


def boost_terms(query) -> Column:
    """The words of a query with two characters or more, as they stand."""
    return F.filter(F.split(query, r"[ \t\r\n\f]+"), lambda t: F.length(t) >= 2)


def is_test_path(path) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/")).rlike(V.TEST_PATH)


def is_small(first, last) -> Column:
    return F.greatest(F.lit(1), last - first + 1) <= V.SNIPPET_LINES


def is_public(exported, text) -> Column:
    return F.coalesce(exported, F.lit(False)) | F.lower(F.ltrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n\f]+", ""))).startswith("export ")


def is_data_literal(kind, text) -> Column:
    """A constant in brackets that is mostly keys and values."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), lambda x: x != "")
    pairs = F.size(F.filter(lines, lambda x: x.rlike(r"""['"`]?[A-Za-z0-9_-]+['"`]?[ \t]*:""")))
    marks = F.length(F.regexp_replace(text, r"""[^"'`:]""", ""))
    dense = F.length(F.regexp_replace(text, r"[ \t\r\n\f]+", ""))
    bracketed = (F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))) | (F.contains(text, F.lit("[")) & F.contains(text, F.lit("]")))
    return (kind == "constant") & bracketed & (pairs >= 2) & (pairs / F.greatest(F.size(lines), F.lit(1)) >= 0.35) & (marks / F.greatest(dense, F.lit(1)) >= 0.04)


def reranked(found: DataFrame, corpus: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The fused rows of each query re-ranked: (query_id, chunk_id, path, type, score, place).

    ``queries`` is (query_id, terms).  A penalty for imports, tests, small pieces or data literals counts only where
    a row with a positive score is none of that kind; every further row of a file counts less.
    """
    rows = found.join(corpus, found.chunk_id == corpus.id).join(queries, "query_id")
    path, text = F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))
    kinds = {
        "import": (F.col("type") == "import", V.IMPORT_FACTOR),
        "test": (is_test_path(path), V.TEST_FACTOR),
        "small": (is_small(F.col("line_start"), F.col("line_end")), V.SNIPPET_FACTOR),
        "literal": (is_data_literal(F.col("type"), text), V.LITERAL_FACTOR),
    }
    slim = rows.select(
        "query_id", "chunk_id", "path", "type", "score", "place", path_boost(path, F.col("terms")).alias("boost"),
        is_public(F.col("exported") if "exported" in corpus.columns else F.col("exports"), text).alias("public"),
        *[F.coalesce(is_kind, F.lit(False)).alias(f"is_{k}") for k, (is_kind, _) in kinds.items()],
    )
    of_query = Window.partitionBy("query_id")
    guarded = slim.select("*", *[(F.max(F.when(~F.col(f"is_{k}"), F.col("score"))).over(of_query) > 0).alias(f"other_{k}") for k in kinds])
    score = F.col("score") * F.col("boost")
    for k, (_, factor) in kinds.items():
        score = score * F.when(F.col(f"is_{k}") & F.coalesce(F.col(f"other_{k}"), F.lit(False)), factor).otherwise(1.0)
    score = score * F.when(F.col("public"), V.API_FACTOR).otherwise(1.0)
    once = guarded.select("query_id", "chunk_id", "path", "type", score.alias("score"), "place")
    order = [F.desc("score"), "place"]
    numbered = once.withColumn("second", F.row_number().over(of_query.orderBy(*order))).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order)))
    factors = V.FILE_FACTORS
    by_file = F.when(F.col("nth") == 1, factors[0]).when(F.col("nth") == 2, factors[1]).when(F.col("nth") == 3, factors[2]).otherwise(factors[3])
    last = numbered.withColumn("score", F.col("score") * by_file)
    place = F.row_number().over(of_query.orderBy(F.desc("score"), "second"))
    best = F.max("score").over(of_query)
    final = last.withColumn("place", place).where(F.col("place") <= limit).withColumn("best", best)
    return final.select("query_id", "chunk_id", "path", "type", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score")).alias("score"), "place")
