import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seekspark.llm import cutting


def words(text):
    return [w for w in re.split("[ \t\r\n\f]+", text) if w]


def checked(text, limit, overlap):
    rows = cutting.cut_texts([text], limit, overlap)
    assert "".join(text[own:end] for _, _, _, end, own, _ in rows) == text
    for (_, number, start, end, own, count), before in zip(rows, [None, *rows]):
        assert len(words(text[start:end])) == count and math.ceil(round(1.3 * count, 6)) <= limit
        if before:
            assert len(words(text[start:own])) == min(overlap, len(words(text[:own])))
    return rows


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \t\n\r.\x0b\xa0é", max_size=600), st.integers(13, 60), st.integers(0, 4))
def test_pieces_cover_repeat_and_fit(text, limit, overlap):
    checked(text, limit, overlap)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300), st.integers(5, 40), st.integers(0, 2))
def test_doubling_equals_walking(ranks, most, overlap):
    import numpy as np

    n, at, want = len(ranks) + 1, 0, []
    while at < n:
        start = max(0, at - overlap)
        far = min(start + most, n)
        to = far
        if far < n:
            for level in (3, 2, 1):
                fits = [g for g in range(max(start + most // 2, at) + 1, far + 1) if ranks[g - 1] >= level]
                if fits:
                    to = fits[-1]
                    break
        at = to
        want.append(at)
    assert cutting.cuts([np.array(ranks), np.array([], np.int64)], most, overlap)[0].tolist() == want


def test_natural_ends_and_lines(spark):
    block = "def f():\n" + "    x = compute(a, b)\n" * 20 + "\n"
    df = spark.createDataFrame([(1, block * 10, 11, "k"), (1, block * 10, 11, "k"), (2, None, 1, ""), (3, "", None, ""), (4, "w " * 384, 1, ""), (5, "w" * 100_000, 1, "")], "id long, text string, line_start int, key string")
    got = cutting.distinct_pieces(df).orderBy("key", "piece").collect()
    mine = [r for r in got if r.key == 1]
    assert len(mine) > 1 and all(r.text.endswith("\n") for r in mine) and mine[0].line_start == 11
    assert mine[-1].line_end == 11 + (block * 10).count("\n") - 1
    lines = (block * 10).split("\n")
    for r in mine:
        assert lines[r.line_end - 11] == r.text.split("\n")[-2 if r.text.endswith("\n") else -1][-200:]
    assert {r.key: sum(x.key == r.key for x in got) for r in got if r.key != 1} == {3: 1, 4: 1, 5: 1}
    assert cutting.pieces(df.limit(0)).count() == 0


def test_overlap_must_leave_room():
    with pytest.raises(ValueError):
        cutting.cuts([__import__("numpy").array([1, 1])], 10, 5)
