from collections import Counter

import numpy as np
import pytest

from seekspark.llm import mixing


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations_are_complete(size):
    n = np.arange(size)
    one = mixing.permuted(n, np.full(size, size), np.full(size, 9))
    two = mixing.permuted(n, np.full(size, size), np.full(size, 10))
    assert sorted(one) == sorted(two) == list(range(size))
    assert size < 16 or (one != two).any() and (one != n).any()


def test_quotas():
    assert sum(mixing.quotas([0.5, 0.3, 0.2], [50, 90, 90])) == 100
    assert mixing.quotas([0.5, 0.5], [10, 1000], 100) == [10, 90]
    assert mixing.quotas([], []) == []


def test_mixture(spark):
    sizes = {"a": 40, "b": 10, "c": 1}
    rows = [(f"{s}{i}", s, 30 + i % 7) for s, n in sizes.items() for i in range(n)] + [("n", None, 5), ("z", "a", 0), ("o", "other", 99)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    mixed = mixing.mixture(docs, targets, block=16, slots=8)
    got = mixed.collect()
    tokens = {k: n for k, _, n in rows}
    used = Counter()
    for r in got:
        for at in range(r.start, r.start + r.length):
            used[r.doc_id, at] += 1
        assert r.start + r.length <= tokens[r.doc_id]
    repeats = {"a": 1, "b": 3, "c": 4}
    assert all(n <= repeats[k[0]] for (k, _), n in used.items())
    slots = {(r.shard, r.slot) for r in got}
    assert len({(r.shard, r.slot, r.source, r.block) for r in got}) == len(slots)
    share = {r.source: r.share for r in mixing.shares(mixed, targets).collect()}
    assert abs(share["a"] - 0.6) < 0.1 and abs(share["b"] - 0.3) < 0.1 and share["gone"] == 0
    assert mixing.mixture(docs, targets, block=16, slots=8).exceptAll(mixed).count() == 0
    assert mixing.mixture(docs.limit(0), targets).count() == 0
