"""The queries of the training-data operators over the test tables, and the SQL twins of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm import abuse, cutting, functions, layout, mixing, neighbours, packing, secrets, tokens
from seekspark.shared import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a chunk's text on which a usable secret value begins."""
    found = secrets.find(table(spark, sf_dir, "chunks"))
    return found.select(F.col("key").alias("chunk_id"), "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with a secret, its text with the values blanked."""
    chunks = table(spark, sf_dir, "chunks").select("id", "text")
    return secrets.redact(chunks).where(F.col("redacted") != F.col("text")).select(F.col("id").alias("chunk_id"), "redacted").dropDuplicates(["chunk_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that the cutting operator had to cut."""
    cut = cutting.pieces(table(spark, sf_dir, "chunks"), bodies=False)
    return cut.where("piece = 1").select(F.col("key").alias("chunk_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk in pieces within the limit."""
    return cutting.distinct_pieces(table(spark, sf_dir, "chunks")).withColumnRenamed("key", "chunk_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of an oversized one, with its container."""
    sized = table(spark, sf_dir, "documents").select("doc_id", tokens.token_count("text").alias("tokens"))
    return packing.containers(sized, "doc_id", "tokens").withColumnRenamed("key", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every permitted capacity its containers, what they hold and the share that is left empty."""
    bins = p6_containers(spark, sf_dir).where("bin is not null").groupBy("bin", "capacity").agg(F.sum("length").alias("held"))
    held = bins.groupBy("capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("held").alias("held"))
    return held.select("capacity", "bins", "held", F.round(1 - F.col("held") / (F.col("bins") * F.col("capacity")), 6).alias("unused"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    listed = table(spark, sf_dir, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return mixing.mixture(listed.select("doc_id", "source", tokens.token_count("text").alias("tokens")), targets), targets


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of which documents fill each slot of the mixture."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the tokens each source was to have, and the share it has."""
    return mixing.shares(*_mixture(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of chunks with a cosine of at least 0.8 of which one is among the ten most similar of the other."""
    near = neighbours.nearest(table(spark, sf_dir, "embedding_results"))
    return near.select(F.least("key", "neighbour").alias("chunk_id_a"), F.greatest("key", "neighbour").alias("chunk_id_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every chunk with a usable vector the most similar other chunks, nearest first."""
    return neighbours.nearest(table(spark, sf_dir, "embedding_results")).withColumnRenamed("key", "chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function or method whose own documentation tells something."""
    return functions.described(table(spark, sf_dir, "ast_nodes")).select(F.col("key").alias("node_id"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions with their code and description."""
    return functions.pairs(table(spark, sf_dir, "ast_nodes")).withColumnRenamed("key", "node_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that nobody wrote by hand for its repository."""
    return layout.judged(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks")).where("kind is not null").select(F.col("id").alias("file_id"))


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the kind it was judged to be, null for hand-written source."""
    return layout.judged(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks")).withColumnRenamed("id", "file_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a sentence whose score reaches the threshold."""
    scored = abuse.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.where(F.col("abuse.score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, density and kind of abuse."""
    scored = abuse.scored(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return scored.select("doc_id", "source", "abuse.score", "abuse.density", "abuse.kind")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its number and rate of documents found."""
    return abuse.rates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p2_found, p2_neighbours, p3_found, p3_pairs, p4_found, p4_pieces, p5_found, p5_kinds, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_scores, p8_rates)
}

SQL = {
    "p4_found": r"""
        SELECT DISTINCT id AS chunk_id FROM chunks
        WHERE 13 * len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) > 5000
    """,
}
