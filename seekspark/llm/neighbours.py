"""Problem 2: the most similar vectors for every vector, by multi-index hashing.

Codes of 256 bits are learned: a bounded sample (``SAMPLE`` vectors, those with the least hashes of their keys) gives
the mean, the principal axes and a rotation of them that brings the coordinates close to their signs (iterative
quantisation); a vector's code is the signs of its rotated coordinates.  The sample only fits the rotation; every
vector is indexed.

A code is split into 16 substrings of 16 bits, each in an index of its own.  Two codes that differ in fewer than 16
bits agree in at least one substring (pigeonhole), and so do most pairs that differ in more, as the differing bits of
similar vectors fall unevenly.  Twelve more indexes hold substrings put together in another way, four bits of each
quarter of the code, which finds most of the rest.  Probing the indexes is an equi-join on (substring number, substring) between the codes
alone; a pair is taken up in the first substring in which it agrees, so none comes twice, and goes on only if the
whole codes differ in at most ``RADIUS`` bits.  The pairs left are ranked by the cosine of their float vectors: each
vector travels to the group of its smallest neighbour once, not once a pair.

What the indexes miss is found by a second, exact pass.  On ``PREFIX`` orthonormal axes the cosine of two unit vectors
is at most the product of their coordinates there plus the product of the lengths of their rests, whatever axes they
are.  Blocks of such prefixes are multiplied with one another, and pairs whose bound reaches ``least`` and the worst
similarity in the full list of one of the two are ranked like the rest.  A looser bound on ``COARSE`` of the axes comes
first, for a strip of vectors that point the same way at a time: vectors for which it reaches ``least`` with none of
the strip are left out of the product.  So the lists are those of a comparison of all
pairs; the indexes only keep the second pass from handing on pairs that no list has room for.

Exact copies are one vector with many keys: copies are never paired with one another.  Of each group of copies the
first k + 1 keys stand for it in the lists of others, since ties go to smaller keys, and every copy is itself a query.

Defined results: rows with a null key and unusable rows (null, of another length, with null, NaN or infinite values, or all zero) are no
vectors; of several usable rows of a key the one with the greatest time counts (null times are least; at equal times
an arbitrary but fixed one); an empty table gives no pair.  Similarities are compared after rounding to 1e-6.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark.shared import cut

DIMENSIONS, BITS, WIDTH, RADIUS = 384, 256, 16, 52
SAMPLE, TURNS, SALTS = 8192, 10, 16
TABLES = BITS // WIDTH + 12
PREFIX, BLOCK, PARTS, SLACK = 192, 8192, 64, 2e-3  # halves round a bound by less than half the slack
COARSE, STRIP, HEAPS = 32, 128, 64
FEW = 1_000_000  # so many pairs go to the vectors, beyond that the vectors are shuffled to the pairs
WORDS = [f"c{i}" for i in range(BITS // 64)]


def _matrix(column, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow list column whose lists all have the given length, and which of them are usable."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimensions)
    return values, np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)


def _units(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def learn(sample: np.ndarray, bits: int = BITS, turns: int = TURNS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the code of a unit vector v is the signs of (v - mean) @ axes."""
    units = _units(sample)
    mean = units.mean(axis=0) if len(units) else np.zeros(sample.shape[1])
    centred = (units - mean).astype(np.float32)
    spread = centred.T @ centred if len(units) else np.eye(sample.shape[1])
    _, axes = np.linalg.eigh(spread)
    axes = axes[:, ::-1][:, :bits].astype(np.float32)
    low = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))[0].astype(np.float32)
    for _ in range(turns if len(units) else 0):
        left, _, right = np.linalg.svd(np.where(low @ turn >= 0, 1, -1).astype(np.float32).T @ low)
        turn = (left @ right).T
    return mean.astype(np.float32), axes @ turn


def codes(values: np.ndarray, model) -> np.ndarray:
    """The codes of vectors as rows of 64-bit words."""
    mean, axes = model
    bits = (_units(values).astype(np.float32) - mean) @ axes > 0
    return np.packbits(bits, axis=1).view(np.int64)


def _hashes(values: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(values + np.float32(0))
    return np.array([divmod(xxhash.xxh3_128_intdigest(r.tobytes()), 1 << 64) for r in rows], np.uint64).reshape(-1, 2).view(np.int64)


def indexed(vectors: DataFrame, key: str, vector: str, at: str, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """(key, h1, h2, code words) of the vector that counts for every key, and the axes of the exact pass; h1 and h2
    hash the vector's content."""
    narrow = vectors.where((F.size(vector) == dimensions) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(vector).alias("vector"))
    # Only about half as many rows again as the sample are sorted, so that no task sees a share of the table.
    share = min(1.0, 1.5 * SAMPLE / max(1, vectors.count()))
    near = narrow.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = near.orderBy(F.xxhash64("key"), "key", "at").limit(SAMPLE).select("vector").toArrow()
    sample, good = _matrix(chosen["vector"], dimensions) if chosen.num_rows else (np.zeros((0, dimensions), np.float32), np.zeros(0, bool))
    model = learn(sample[good])
    units = _units(sample[good])
    axes = np.linalg.eigh(units.T @ units)[1][:, ::-1][:, :PREFIX]

    def encode(batches):
        for batch in batches:
            values, usable = _matrix(batch.column("vector"), dimensions)
            keep = pa.array(usable)
            hashed, words = _hashes(values[usable]), codes(values[usable], model) if usable.any() else np.zeros((0, len(WORDS)), np.int64)
            columns = [batch.column("key").filter(keep), batch.column("at").filter(keep)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(hashed[:, i]) for i in (0, 1)] + [pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(WORDS))], names=["key", "at", "h1", "h2", *WORDS])

    encoded = narrow.mapInArrow(encode, "key long, at timestamp, h1 long, h2 long, " + ", ".join(f"{w} long" for w in WORDS))
    latest = encoded.groupBy("key").agg(F.max(F.struct("at", "h1", "h2", *WORDS)).alias("v"))
    return cut(latest.select("key", "v.h1", "v.h2", *[f"v.{w}" for w in WORDS])), axes


def grouped(index: DataFrame, k: int) -> DataFrame:
    """(rep, h1, h2, words, firsts): every distinct vector with its smallest key and its first k + 1 keys."""
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("key"))
    first = index.withColumn("place", place).where(F.col("place") <= k + 1)
    return cut(first.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.sort_array(F.collect_list("key")).alias("firsts"), *[F.first(w).alias(w) for w in WORDS]))


def _first(batches):
    """The pairs whose table is the first in which their codes agree, given the words in which they differ."""
    for batch in batches:
        differ = np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1)
        fours = reduce(np.bitwise_or, (np.bitwise_or(w >> np.uint64(20 * n), w << np.uint64(64 - 20 * n)) if n else w for n, w in enumerate(differ.view(np.uint64).T)))
        fours = np.stack([fours >> np.uint64(4 * t) & np.uint64(15) for t in range(TABLES - BITS // WIDTH)], axis=1)
        agree = np.concatenate([differ.view(np.uint16) == 0, fours == 0], axis=1)
        keep = pa.array(agree.argmax(axis=1) == batch.column("t").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def probed(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: the pairs of distinct vectors that share a substring and differ in at most ``radius`` bits."""

    def part(t: int):
        if t < BITS // WIDTH:
            return F.shiftrightunsigned(F.col(WORDS[t // 4]), t % 4 * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
        fours = [F.shiftleft(F.shiftrightunsigned(F.col(w), 4 * ((t + 5 * n) % 16)).bitwiseAND(F.lit(15)), 4 * n) for n, w in enumerate(WORDS)]
        return reduce(lambda x, y: x.bitwiseOR(y), fours)

    keys = F.array(*[(part(t) + F.lit(t << WIDTH)).cast("int") for t in range(TABLES)])
    probes = groups.select("rep", *WORDS, F.explode(keys).alias("bucket"))
    a, b = probes.alias("a"), probes.alias("b")
    joined = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rep") < F.col("b.rep")))
    differ = joined.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.shiftright(F.col("a.bucket"), WIDTH).alias("t"), *[F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}")).alias(w) for w in WORDS])
    distance = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0]))
    # The condition of the join stays short: the JVM does not compile methods of more than 8,000 bytes of code.
    return differ.where(distance <= radius).mapInArrow(_first, "a long, b long")


def _cosines(dimensions: int, least: float):
    """Cosines of the wanted pairs of each group; rows come sorted by group, and groups may span batches."""

    def of(table: pa.Table):
        values, usable = _matrix(table["vector"], dimensions)
        group, key = table["group"].to_numpy(), table["key"].to_numpy()
        wanted = np.stack([table["h1"].to_numpy(), table["h2"].to_numpy()], axis=1)
        same = usable.copy()
        same[usable] = (_hashes(values[usable]) == wanted[usable]).all(axis=1)
        units = _units(values[same])
        place = {pair: n for n, pair in enumerate(zip(group[same].tolist(), key[same].tolist()))}
        rows = np.flatnonzero(same)
        done, left, right = set(), [], []
        for n, r in enumerate(rows.tolist()):
            own = (int(group[r]), int(key[r]))
            if own in done:
                continue
            done.add(own)
            for partner in table["partners"][r].as_py():
                left.append(n)
                right.append(place[own[0], partner])
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        cosine = np.zeros(len(left))
        for at in range(0, len(left), 8192):
            cosine[at : at + 8192] = np.einsum("ij,ij->i", units[left[at : at + 8192]], units[right[at : at + 8192]])
        cosine = np.round(cosine, 6)
        keep = cosine >= least
        keys = key[same]
        return pa.RecordBatch.from_arrays([pa.array(keys[left[keep]]), pa.array(keys[right[keep]]), pa.array(cosine[keep])], names=["a", "b", "cosine"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            group = table["group"].to_numpy()
            border = int(np.searchsorted(group, group[-1]))
            if border:
                yield of(table.slice(0, border))
            held = table.slice(border)
        if held is not None and held.num_rows:
            yield of(held)

    return run


def similar(vectors: DataFrame, groups: DataFrame, links: DataFrame, key: str, vector: str, least: float, dimensions: int = DIMENSIONS, few: bool = False) -> DataFrame:
    """(a, b, cosine) of the links whose float vectors are at least so similar; a few links are broadcast."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    leader = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("group"))
    owned = links.join(leader, "a")
    wanted = owned.select("group", F.col("a").alias("key"), F.col("b").alias("partner")).unionByName(owned.select("group", F.col("b").alias("key"), F.lit(None).cast("long").alias("partner")).distinct())
    need = wanted.groupBy("group", "key").agg(F.collect_list("partner").alias("partners")).join(groups.select(F.col("rep").alias("key"), "h1", "h2"), "key")
    rows = vectors.where(F.size(vector) == dimensions).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    sent = rows.join(F.broadcast(need) if few else need, "key").select("group", "key", "h1", "h2", "partners", "vector").repartition("group").sortWithinPartitions("group", "key")
    return sent.mapInArrow(_cosines(dimensions, least), "a long, b long, cosine double")


def _coarse(z: np.ndarray) -> np.ndarray:
    """The first coordinates of prefixes and the lengths of their rests: products of these are no less than those of the prefixes."""
    return np.c_[z[:, :COARSE], np.linalg.norm(z[:, COARSE:], axis=1)]


def _heaped(z: np.ndarray) -> np.ndarray:
    """An order of prefixes in which those that point the same way are neighbours."""
    low = _coarse(z.astype(np.float32))[:, :-1]
    centres = low[:: -(-len(low) // HEAPS)]
    for _ in range(4):
        nearest = (low @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        centres = np.stack([low[nearest == n].mean(axis=0) for n in np.unique(nearest)])
    return (low @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1).argsort(kind="stable")


def _blocks(batches):
    """The rows of a partition as blocks: numbers, keys, floors and prefixes packed into one row each."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            z = np.frombuffer(b"".join(part.column("z").to_pylist()), np.float16).reshape(part.num_rows, -1)
            order = _heaped(z)
            packed = [part.column("key").to_numpy()[order].tobytes(), part.column("floor").to_numpy()[order].astype(np.float32).tobytes(), z[order].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number])] + [pa.array([p], pa.binary()) for p in packed], names=["block", "keys", "floors", "zs"])
            number += 1


def _reaching(least: float):
    """The pairs of two blocks whose bounds reach the floor of one of them."""

    def unpacked(batch, row: int, side: str):
        keys, floors, zs = (np.frombuffer(batch.column(c + side)[row].as_py(), t) for c, t in (("keys", np.int64), ("floors", np.float32), ("zs", np.float16)))
        return keys, floors, zs.reshape(len(keys), -1).astype(np.float32)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (ka, fa, za), (kb, fb, zb) = unpacked(batch, row, ""), unpacked(batch, row, "_b")
                ca, cb = _coarse(za), _coarse(zb)
                one = batch.column("block")[row] == batch.column("block_b")[row]
                tried, left_over = 0, 0.0
                for i in range(0, len(ka), STRIP):
                    first = i if one else 0
                    near, zn = np.arange(first, len(kb)), zb[first:]
                    if left_over <= tried / 2 + 2:  # else the coarse bound spares too little in these blocks
                        reach = (ca[i : i + STRIP] @ cb[first:].T).max(axis=0) >= least - SLACK - 1e-5
                        tried, left_over = tried + 1, left_over + reach.mean()
                        if reach.mean() <= 0.5:
                            near, zn = near[reach], zn[reach]
                    bound = za[i : i + STRIP] @ zn.T
                    p, q = np.divmod(np.flatnonzero(bound >= least - SLACK), max(1, len(near)))
                    p, q, bound = i + p, near[q], bound[p, q]
                    keep = (bound >= np.minimum(fa[p], fb[q]) - SLACK) & (ka[p] != kb[q])
                    left, right = ka[p[keep]], kb[q[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

    return run


def bounded(vectors: DataFrame, groups: DataFrame, floors: DataFrame, axes: np.ndarray, key: str, vector: str, least: float, dimensions: int = DIMENSIONS) -> DataFrame:
    """(a, b), a < b: every pair of distinct vectors that may be as similar as the floor of one of the two."""

    def project(batches):
        for batch in batches:
            values, usable = _matrix(batch.column("vector"), dimensions)
            values = values[usable]
            low = _units(values) @ axes
            rest = np.sqrt(np.maximum(0, 1 - (low**2).sum(axis=1)))
            hashed, z = _hashes(values), np.c_[low, rest].astype(np.float16)
            columns = [batch.column("key").filter(pa.array(usable)), *(pa.array(hashed[:, i]) for i in (0, 1)), pa.array([r.tobytes() for r in z], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "v1", "v2", "z"])

    count = groups.count()
    parts = max(8, min(PARTS, -(-count // BLOCK)))
    rows = vectors.where((F.size(vector) == dimensions) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    lowest = groups.select(F.col("rep").alias("a"), "h1", "h2").join(floors, "a", "left").select(F.col("a").alias("key"), "h1", "h2", F.coalesce("floor", F.lit(least)).alias("floor"))
    placed = rows.mapInArrow(project, "key long, v1 long, v2 long, z binary").join(lowest, "key").where("v1 = h1 AND v2 = h2").coalesce(parts)
    blocks = cut(placed.select("key", "floor", "z").mapInArrow(_blocks, "block long, keys binary, floors binary, zs binary"))
    # Pairs of blocks are read from the checkpoint, not shuffled, and go to Python one by one, as they are large.
    other = blocks.select(*[F.col(c).alias(c + "_b") for c in blocks.columns]).hint("shuffle_replicate_nl")
    conf, name = vectors.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1")
    try:
        return cut(blocks.join(other, F.col("block") <= F.col("block_b")).mapInArrow(_reaching(least), "a long, b long"))
    finally:
        conf.set(name, before)


def _lists(pairs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(a, list): the k + 1 most similar keys of every distinct vector, its own copies among them."""
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    own = groups.where(F.size("firsts") > 1).select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"))
    found = ways.unionByName(own).join(groups.select(F.col("rep").alias("b"), "firsts"), "b").select("a", "cosine", F.explode("firsts").alias("other"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "other", "cosine"))).alias("list"))


def nearest(vectors: DataFrame, key: str = "chunk_id", vector: str = "vector", at: str = "embedded_at", k: int = 10, least: float = 0.8, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, place, neighbour, similarity): for every key its k most similar others, nearest first, ties by key."""
    index, axes = indexed(vectors, key, vector, at, dimensions)
    groups = grouped(index, k)
    links = cut(probed(groups))
    near = similar(vectors, groups, links, key, vector, least, dimensions)
    pairs = cut(near)
    full = _lists(pairs, groups, k).where(F.size("list") > k).select("a", F.element_at("list", k + 1)["cosine"].alias("floor"))
    missed = cut(bounded(vectors, groups, full, axes, key, vector, least, dimensions).distinct().join(pairs, ["a", "b"], "left_anti"))
    pairs = pairs.unionByName(cut(similar(vectors, groups, missed, key, vector, least, dimensions, missed.count() <= FEW)))
    lists = _lists(pairs, groups, k)
    salted = groups.where(F.size("firsts") > 1).select("h1", "h2", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = index.select("key", "h1", "h2", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["h1", "h2", "salt"]).where("key <> rep").select("key", F.col("rep").alias("a"), "salt")
    of_copies = copies.join(lists.join(groups.where(F.size("firsts") > 1).select(F.col("rep").alias("a")), "a", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"])
    queries = lists.select(F.col("a").alias("key"), "list").unionByName(of_copies.select("key", "list"))
    others = F.slice(F.filter("list", lambda x: x["other"] != F.col("key")), 1, k)
    return queries.select("key", F.posexplode(others).alias("place", "n")).select("key", (F.col("place") + 1).alias("place"), F.col("n.other").alias("neighbour"), F.col("n.cosine").alias("similarity"))
