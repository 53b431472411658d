"""Problem 7: mix sources to target weights.

The texts of each source, in a fixed order, are one long row of tokens, cut into blocks of a fixed length.  The
output is made of shards with a fixed number of slots, each slot one block.  Every shard draws how many of its slots
go to each source from a multinomial distribution with the target weights, by a generator seeded with the shard's
number.  The draws of a source are numbered through all shards, and a pseudorandom permutation of its block numbers
(a keyed Feistel network on the next power of four, walked until it falls into the range) says which block a draw
takes; after all blocks have been used once, the next pass permutes them under another key.  Draws and blocks are
then joined by (source, block).  The slots within a shard are permuted in the same way, so sources alternate.

The number of slots, unless given, is the largest at which every source can fill its share with its tokens and its
``max_repeats``; a larger number given makes scarce sources fall short, and the shares report shows what was reached.
Multinomial draws miss the exact numbers of blocks by chance, so the draws of a source beyond its number are handed,
in the order of their numbers, to the sources that were drawn too seldom.  No document is used more than
``max_repeats`` times, as a pass uses each block once.

Defined results: sources without documents or tokens, or with a null or not positive weight or ``max_repeats``, get
no slot and their weight goes to the others in proportion; documents of sources that are not listed, null sources and
empty texts are not used; repeated rows of documents count as texts of their own; the last block of a source may be
shorter than the others.  With no usable source the mixture is empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.shared import cut

BLOCK, SLOTS, SEED = 256, 256, 20250101
_PER_SALT = 50_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hashed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``index`` in the permutation of 0 .. ``size`` - 1 that belongs to ``key``; all by element."""
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.array([max(1, (max(int(s) - 1, 1).bit_length() + 1) // 2) for s in np.unique(size)], np.uint64)[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (_hashed(right, k * np.uint64(4) + np.uint64(turn)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def quotas(weights: list[float], caps: list[int], total: int | None = None) -> list[int]:
    """How many blocks each source gives.  Without ``total`` it is the largest mixture in which every share is exact to
    a block; with it, sources that cannot give their share give all they may and the others share the rest by weight."""
    if not weights:
        return []
    if total is None:
        total = max(1, min(int(c / w) for w, c in zip(weights, caps)))
    given, free = [0] * len(weights), list(range(len(weights)))
    while free:
        rest, weight = total - sum(given), sum(weights[i] for i in free)
        full = [i for i in free if caps[i] < int(rest * weights[i] / weight)]
        if not full:
            for i in free:
                given[i] = int(rest * weights[i] / weight)
            break
        for i in full:
            given[i] = caps[i]
        free = [i for i in free if i not in full]
    lacking = sorted(range(len(weights)), key=lambda i: (given[i] - total * weights[i], i))
    for i in lacking[: total - sum(given)]:
        given[i] += given[i] < caps[i]
    return given


def blocks(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of texts in blocks: (source, block, key, start, length), from (key, source, tokens) with tokens above 0."""
    total = documents.count()
    salts = max(1, -(-total // _PER_SALT))
    salted = documents.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("source", "salt").agg(F.sum("tokens").alias("__n"))
    above = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "salt", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "salt").orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = salted.withColumn("__to", inside).join(offsets, ["source", "salt"]).select("source", "key", "tokens", (F.col("__before") + F.col("__to") - F.col("tokens")).alias("__from"))
    size = F.lit(block).cast("long")
    spread = placed.select("*", F.explode(F.sequence(F.expr(f"__from div {block}"), F.expr(f"(__from + tokens - 1) div {block}"))).alias("block"))
    start = F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("__from"))
    end = F.least(F.col("tokens"), (F.col("block") + 1) * size - F.col("__from"))
    return spread.select("source", "block", "key", start.alias("start"), (end - start).alias("length"))


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", block: int = BLOCK, slots: int = SLOTS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows (shard, slot, source, pass, block, key, start, length): which tokens of which text fill each slot.

    ``targets`` has source, weight and max_repeats; it is a mixture's recipe and small, with a row per source.
    """
    spark = documents.sparkSession
    wanted = {r.source: (float(r.weight), int(r.max_repeats)) for r in targets.dropDuplicates(["source"]).collect() if r.source is not None and (r.weight or 0) > 0 and (r.max_repeats or 0) > 0}
    used = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")).where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    used = cut(used)
    have = {r.source: -(-r.n // block) for r in used.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    names = sorted(have)
    whole = sum(wanted[s][0] for s in names)
    weights = [wanted[s][0] / whole for s in names]
    caps = [have[s] * wanted[s][1] for s in names]
    quota = quotas(weights, caps, total)
    n_slots = sum(quota)
    shards = -(-n_slots // slots)

    def draw(frames):
        for frame in frames:
            rows = []
            for shard in frame["id"].tolist():
                here = min(slots, n_slots - shard * slots)
                before = 0
                for i, n in enumerate(np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(here, weights).tolist()):
                    rows.append((shard, here, i, before, n))
                    before += n
            yield pd.DataFrame(rows, columns=["shard", "here", "place", "before", "n"])

    counts = spark.range(shards).mapInPandas(draw, "shard long, here long, place int, before long, n long")
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).where("n > 0")
    draws = numbered.select("shard", "here", "place", "before", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    n_blocks = np.array([have[s] for s in names], np.int64)
    drawn = np.zeros(len(names), np.int64)
    for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        drawn[r.place] = r.n
    most = np.array(quota, np.int64)
    over, under = np.maximum(drawn - most, 0), np.maximum(most - drawn, 0)
    over_from, under_to = np.cumsum(over) - over, np.cumsum(under)

    def choose(frames):
        for f in frames:
            place, number = f["place"].to_numpy(), (f["first"] + f["i"]).to_numpy()
            moved = np.flatnonzero(number >= most[place])
            handed = over_from[place[moved]] + number[moved] - most[place[moved]]
            taker = np.searchsorted(under_to, handed, "right")
            place, number = place.copy(), number.copy()
            place[moved], number[moved] = taker, drawn[taker] + handed - (under_to - under)[taker]
            size = n_blocks[place]
            turn = number // size
            with np.errstate(over="ignore"):
                chosen = permuted(number % size, size, seed + place * 1_000_003 + turn * 7_919)
                slot = permuted((f["before"] + f["i"]).to_numpy(), f["here"].to_numpy(), seed + 17 + f["shard"].to_numpy())
            yield pd.DataFrame({"shard": f["shard"].to_numpy(), "slot": slot, "source": [names[p] for p in place], "pass": turn, "block": chosen})

    chosen = draws.mapInPandas(choose, "shard long, slot long, source string, pass long, block long")
    return chosen.join(blocks(used, block), ["source", "block"]).select("shard", "slot", "source", "pass", "block", F.col("key").alias(key), "start", "length")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target's wanted and reached share of the tokens: (source, weight, tokens, share)."""
    got = mixed.groupBy("source").agg(F.sum("length").alias("tokens"))
    total = got.agg(F.sum("tokens").alias("__all"))
    wanted = targets.dropDuplicates(["source"]).select("source", "weight")
    return wanted.join(got, "source", "left").join(F.broadcast(total)).select("source", "weight", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("share"))
