import numpy as np
import pyarrow as pa

from seekspark.llm import neighbours


def table(spark, rows):
    data = [(None if i is None else int(i), None if v is None else [float(x) for x in v], t) for i, v, t in rows]
    return spark.createDataFrame(data, "chunk_id long, vector array<float>, at string").selectExpr("chunk_id", "vector", "cast(at as timestamp) as embedded_at")


def brute(vectors, k, least):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = set()
    for a in range(len(ids)):
        others = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))
        out |= {(ids[a], ids[b]) for b in others[:k]}
    return out


def test_recall_copies_and_dirt(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 384))
    vectors = {i: (centres[i % 60] + rng.normal(scale=0.35, size=384)).astype(np.float32) for i in range(600)}
    for i in range(600, 630):
        vectors[i] = vectors[5].copy()
    day = "2025-01-02 00:00:00"
    rows = [(i, v, day) for i, v in vectors.items()]
    rows += [(3, vectors[3], day), (7, vectors[9], "2025-01-01 00:00:00"), (8, vectors[9], None)]
    rows += [(None, vectors[1], day), (900, None, day), (901, np.zeros(384), day), (902, np.ones(12), day), (903, np.r_[np.nan, np.ones(383)], day), (10, np.zeros(384), "2025-02-01 00:00:00")]
    got = neighbours.nearest(table(spark, rows), k=10, least=0.8).collect()
    want = brute(vectors, 10, 0.8)
    found = {(r.key, r.neighbour) for r in got}
    assert len(found & want) / len(want) >= 0.9 and len(found - want) <= 0.05 * len(want)
    of = lambda q: [r.neighbour for r in sorted((r for r in got if r.key == q), key=lambda r: r.place)]
    assert of(620) == [5, *range(600, 609)] and of(5) == list(range(600, 610)) and of(603) == [5, 600, 601, 602, *range(604, 610)]


def test_nothing_and_one(spark):
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, [(1, np.ones(384), None)])).count() == 0
    got = neighbours.nearest(table(spark, [(1, np.ones(384), None), (2, np.ones(384), None)])).collect()
    assert sorted((r.key, r.neighbour, r.similarity) for r in got) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_pairs_that_the_indexes_miss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 32)  # codes that fit the vectors badly
    rng = np.random.default_rng(11)
    units = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    one = units(rng.normal(size=(400, 384)))
    side = rng.normal(size=(400, 384))
    side = units(side - (side * one).sum(axis=1, keepdims=True) * one)
    cosine = np.linspace(0.795, 0.85, 400)[:, None]
    both = np.concatenate([one, cosine * one + np.sqrt(1 - cosine**2) * side]).astype(np.float32)
    centre = units(rng.normal(size=(1, 384)))
    crowd = units(centre + 0.4 * units(rng.normal(size=(200, 384)))).astype(np.float32)
    vectors = dict(enumerate(np.concatenate([both, crowd])))
    got = neighbours.nearest(table(spark, [(i, v, None) for i, v in vectors.items()]), k=5).collect()
    assert {(r.key, r.neighbour) for r in got} == brute(vectors, 5, 0.8)


def test_probes_come_once_from_code_that_the_jvm_compiles(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**63), 2**63, size=(20, 4))
    words = np.concatenate([words, *[words ^ np.packbits(rng.random((20, 256)) < p, axis=1).view(np.int64) for p in (0.02, 0.08, 0.15, 0.2)]])
    groups = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "rep long, c0 long, c1 long, c2 long, c3 long")
    lanes, nibbles = words.view(np.uint16), (words[:, :, None].view(np.uint64) >> np.arange(0, 64, 4, dtype=np.uint64)) & np.uint64(15)
    want = set()
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            shared = (lanes[a] == lanes[b]).any() or any(all(nibbles[a, n, (t + 5 * n) % 16] == nibbles[b, n, (t + 5 * n) % 16] for n in range(4)) for t in range(12))
            if shared and np.bitwise_count((words[a] ^ words[b]).view(np.uint64)).sum() <= neighbours.RADIUS:
                want.add((a, b))
    got = [tuple(r) for r in neighbours.probed(groups).collect()]
    assert len(want) > 50 and set(got) == want and len(got) == len(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = neighbours.probed(groups)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [parts.apply(n)._3().maxMethodCodeSize() for n in range(parts.size())]
    assert sizes and 0 < max(sizes) < 8000


def test_the_coarse_bound_leaves_out_no_pair():
    rng = np.random.default_rng(6)
    z = np.concatenate([c + rng.normal(scale=0.04, size=(90, 193)) for c in rng.normal(scale=0.05, size=(7, 193))] + [rng.normal(size=(70, 193))])
    z[:, -1] = abs(z[:, -1])
    z = (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float16)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), pa.array(np.full(len(z), 0.5)), pa.array([r.tobytes() for r in z], pa.binary())], names=["key", "floor", "z"])
    order = neighbours._heaped(z)
    assert sorted(order) == list(range(len(z))) and sorted(neighbours._heaped(z[:1])) == [0]
    packed = [rows.column("key").to_numpy()[order].tobytes(), np.full(len(z), 0.5, np.float32).tobytes(), z[order].tobytes()]
    wide = z.astype(np.float32) @ z.astype(np.float32).T >= 0.5 - neighbours.SLACK
    want = {(int(a), int(b)) for a, b in np.argwhere(wide) if a < b}
    for other in (0, 1):
        columns = [pa.array([0]), *(pa.array([p], pa.binary()) for p in packed), pa.array([other]), *(pa.array([p], pa.binary()) for p in packed)]
        got = pa.Table.from_batches(list(neighbours._reaching(0.5)([pa.RecordBatch.from_arrays(columns, names=["block", "keys", "floors", "zs", "block_b", "keys_b", "floors_b", "zs_b"])])))
        assert set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == want and len(want) > 1000
