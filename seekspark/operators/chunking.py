"""From parsed nodes to chunks: imports of a file as one, large nodes split, small constants merged.

Everything is folds over arrays within a file, in the JVM; a file's nodes are one row, bounded by the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.functions.text import chunk_id, short_hash, token_estimate, words

PIECE = "struct<first:int,last:int,words:int>"
CHUNK = "struct<line_start:int,line_end:int,type:string,name:string,parent:string,text:string,tokens:bigint,exports:boolean,imports:array<string>>"


def split_lines(text, most: int) -> Column:
    """Runs of lines (first, last, words), counted from 0: a run ends before the line that would bring its estimate
    to ``most`` tokens, unless it holds no other line."""
    per_line = F.transform(F.split(text, "\n"), lambda x: F.size(words(x)))
    start = F.from_json(F.lit('{"done":[],"first":0,"line":0,"words":0}'), f"done array<{PIECE}>, first int, line int, words int")

    def step(state, n):
        total = state["words"] + n
        full = (F.ceil(total * F.lit(V.TOKENS_PER_WORD).cast("double")) >= most) & (state["line"] > state["first"])
        piece = F.struct(state["first"].alias("first"), (state["line"] - 1).alias("last"), state["words"].alias("words"))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(piece))).otherwise(state["done"]).alias("done"),
            F.when(full, state["line"]).otherwise(state["first"]).alias("first"),
            (state["line"] + 1).alias("line"),
            F.when(full, n).otherwise(total).alias("words"),
        )

    return F.aggregate(per_line, start, step, lambda s: F.concat(s["done"], F.array(F.struct(s["first"], (s["line"] - 1).alias("last"), s["words"]))).cast(f"array<{PIECE}>"))


def split_large(df: DataFrame, text: str = "text", line: str = "line_start", most: int = V.MAX_TOKENS) -> DataFrame:
    """``df`` with a row for every piece: ``piece``, its ``line_start`` and ``line_end``, and its lines as text.
    Texts within the limit are one piece that keeps its ``line_end``."""
    whole = token_estimate(text) <= most
    runs = F.when(whole, F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("words")).cast(PIECE))).otherwise(split_lines(F.col(text), most))
    spread = df.select("*", F.posexplode(runs).alias("piece", "run"))
    lines = F.array_join(F.slice(F.split(text, "\n"), F.col("run.first") + 1, F.greatest(F.col("run.last") - F.col("run.first") + 1, F.lit(0))), "\n")
    kept = F.col("run.last") < 0
    return spread.withColumns(
        {
            text: F.when(kept, F.col(text)).otherwise(lines),
            "line_end": F.when(kept, F.col("line_end")).otherwise(F.col(line) + F.col("run.last")),
            line: F.when(kept, F.col(line)).otherwise(F.col(line) + F.col("run.first")),
        }
    ).drop("run")


def grouped_imports(nodes: DataFrame) -> DataFrame:
    """One row (file_id, line_start, line_end, text) for all imports of a file, in the order of lines."""
    listed = nodes.where("type = 'import'").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_start", "node_id", "line_end", "text"))).alias("n"))
    return listed.select("file_id", F.element_at("n", 1)["line_start"].alias("line_start"), F.element_at("n", -1)["line_end"].alias("line_end"), F.array_join(F.transform("n", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def without_split_classes(nodes: DataFrame) -> DataFrame:
    """The nodes except classes whose methods are nodes of their own."""
    owners = nodes.where("type = 'method' and parent is not null").select("file_id", F.col("parent").alias("name")).distinct()
    classes = nodes.where("type = 'class'").join(owners, ["file_id", "name"], "left_anti")
    return nodes.where("type is null or type <> 'class'").unionByName(classes.select(nodes.columns))


def merged_constants(chunks: Column, most: int = V.MAX_TOKENS) -> Column:
    """An array of chunks of one file in the order of lines, neighbouring small constants merged while they fit."""
    start = F.struct(F.array().cast(f"array<{CHUNK}>").alias("done"), F.lit(None).cast(CHUNK).alias("held"))

    def step(state, c):
        done, held = state["done"], state["held"]
        small = (c["tokens"] < V.MERGE_TOKENS) & ~c["type"].isin(*V.CLASS_TYPES)
        joins = held.isNotNull() & small & (held["type"] == c["type"]) & (held["tokens"] + c["tokens"] <= most)
        text = F.concat(held["text"], F.lit("\n"), c["text"])
        both = F.struct(
            held["line_start"].alias("line_start"), c["line_end"].alias("line_end"), held["type"].alias("type"), F.coalesce(held["name"], c["name"]).alias("name"), held["parent"].alias("parent"),
            text.alias("text"), token_estimate(text).alias("tokens"), held["exports"].alias("exports"), held["imports"].alias("imports"),
        ).cast(CHUNK)
        flushed = F.when(held.isNull(), done).otherwise(F.concat(done, F.array(held)))
        return F.struct(
            F.when(joins, done).when(small, flushed).otherwise(F.concat(flushed, F.array(c))).alias("done"),
            F.when(joins, both).when(small, c).otherwise(F.lit(None).cast(CHUNK)).alias("held"),
        )

    return F.aggregate(chunks, start, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def chunked(nodes: DataFrame, most: int = V.MAX_TOKENS) -> DataFrame:
    """All chunks of all files: (file_id, path, line_start, line_end, type, name, parent, text, exports, imports, id, hash).

    ``nodes`` is (node_id, file_id, path, type, name, parent, line_start, line_end, text, exports); null texts count
    as empty.
    """
    clean = nodes.withColumns({"text": F.coalesce("text", F.lit("")), "exports": F.coalesce("exports", F.lit(False)), "line_end": F.coalesce("line_end", "line_start")})
    imports = clean.where("type = 'import'").groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]).alias("imports"))
    paths = clean.groupBy("file_id").agg(F.max("path").alias("path"))
    first = grouped_imports(clean).select("file_id", "line_start", "line_end", F.lit("import").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("parent"), "text", F.lit(False).alias("exports"), F.lit(-1).cast("long").alias("node_id"), F.lit(0).alias("piece"))
    others = split_large(without_split_classes(clean.where("type is null or type <> 'import'")), most=most).select(first.columns)
    with_imports = others.join(imports, "file_id", "left").unionByName(first.withColumn("imports", F.array().cast("array<string>")))
    one = F.struct("line_start", "node_id", "piece", F.struct("line_start", "line_end", "type", "name", "parent", "text", token_estimate("text").alias("tokens"), "exports", F.coalesce("imports", F.array().cast("array<string>")).alias("imports")).cast(CHUNK).alias("c"))
    by_file = with_imports.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]).alias("chunks"))
    rows = by_file.join(paths, "file_id").select("file_id", "path", F.explode(merged_constants(F.col("chunks"), most)).alias("c"))
    flat = rows.select("file_id", "path", "c.line_start", "c.line_end", "c.type", "c.name", "c.parent", "c.text", "c.exports", "c.imports")
    return flat.withColumn("id", chunk_id("path", "line_start", "line_end")).withColumn("hash", short_hash("text"))
