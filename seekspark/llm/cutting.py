"""Problem 4: cut oversized texts at natural boundaries, with overlap, by pointer doubling.

The size of a text is ceil(1.3 x words); words are the runs of characters between blanks, tabs, line feeds, carriage
returns and form feeds.  Every gap between two words is a boundary with a rank: a gap at a blank line or before a
line without indentation ranks above a line end, that above the end of a sentence or clause, that above a plain gap.

Each boundary is joined to its farthest legal successor: the piece that begins ``overlap`` words before the boundary
and ends at the successor is within the limit, and of the gaps that leave the piece at least half full the last one
of the best rank is taken.  The table of successors is then squared again and again; with every squaring the known
cuts double, so all greedy cuts of all texts of a batch are found in log2(cuts) steps of array operations.

Defined results: null texts give no piece; a text within the limit gives one piece, itself; the pieces without their
overlaps, joined, are the text.  A null ``line_start`` counts as 1.  Rows that repeat a key and text give their
pieces once.  A single word is never cut, however long, since it has size 2.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 500, 30
_BATCH_CHARS = 4_000_000


def most_words(limit: int) -> int:
    """The most words whose size ceil(1.3 x words) is within the limit."""
    return limit * 10 // 13


_OTHER_BLANKS = re.compile("[\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def count_words(text: str) -> int:
    if _OTHER_BLANKS.search(text):
        return len(re.findall("[^ \t\n\r\f]+", text))
    return len(text.split())


def _gaps(text: str):
    """The words' starts, and of each gap between two words its cut position and rank."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13) & (raw != 11))
    word = ~blank
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.flatnonzero(raw == 10)
    left, right = ends[:-1], starts[1:]
    first, behind = np.searchsorted(breaks, left), np.searchsorted(breaks, right)
    lines = behind - first
    last_break = breaks[np.maximum(behind - 1, 0)] if len(breaks) else np.zeros(len(left), np.int64)
    at = np.where(lines > 0, last_break + 1, right)
    closing = np.isin(raw[left - 1], np.array([ord(c) for c in ".!?;:,)}]"], np.uint32))
    rank = np.where(lines > 0, 2, closing.astype(np.int64))
    rank = np.where((lines > 1) | ((lines == 1) & (right == at)), 3, rank)
    return starts, at, rank


def cuts(ranks: list[np.ndarray], most: int, overlap: int) -> list[np.ndarray]:
    """For every text, given the ranks of its inner gaps, the word counts at which its pieces end."""
    if overlap < 0 or 2 * overlap >= most:
        raise ValueError("the overlap must be below half of the limit")
    sizes = np.array([len(r) + 1 for r in ranks], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    total = int(first[-1])
    # Node first[t] + g of text t is the gap behind g words; the last node of a text is its end and leads to itself.
    rank = np.full(total, -1, np.int64)
    for t, r in enumerate(ranks):
        rank[first[t] + 1 : first[t] + sizes[t]] = r
    text = np.repeat(np.arange(len(ranks)), sizes + 1)
    base, end = first[text], first[text] + sizes[text]
    node = np.arange(total)
    start = np.maximum(node - overlap, base)
    far = np.minimum(start + most, end)
    half = np.maximum(start + most // 2, node)
    successor = far.copy()
    chosen = far == end
    for level in (3, 2, 1):
        last = np.maximum.accumulate(np.where(rank >= level, node, -1))[far]
        take = ~chosen & (last > half)
        successor[take] = last[take]
        chosen |= take
    reached = np.zeros(total, bool)
    reached[first[:-1]] = True
    jump = successor
    while True:
        before = int(reached.sum())
        reached[jump[reached]] = True
        if int(reached.sum()) == before:
            break
        jump = jump[jump]
    found = np.flatnonzero(reached)
    found = found[found != first[text[found]]]
    owner = text[found]
    return np.split(found - first[owner], np.searchsorted(owner, np.arange(1, len(ranks))))


def cut_texts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP):
    """Rows (text index, piece number, start, end, first own character, words) for all texts."""
    most = most_words(limit)
    words = [count_words(t) for t in texts]
    large = [i for i, n in enumerate(words) if n > most]
    rows = [(i, 0, 0, len(texts[i]), 0, n) for i, n in enumerate(words) if n <= most]
    split = [_gaps(texts[i]) for i in large]
    for k, ends in enumerate(cuts([s[2] for s in split], most, overlap) if split else []):
        t = large[k]
        word_starts, at, _ = split[k]
        where = np.concatenate(([0], at, [len(texts[t])]))
        previous = 0
        for p, e in enumerate(ends.tolist()):
            s = max(0, previous - overlap)
            rows.append((t, p, int(where[s] if s == 0 or s == previous else word_starts[s]), int(where[e]), int(where[previous]), e - s))
            previous = e
    return rows


def _lines(text: str):
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)


def _pieces(limit: int, overlap: int, bodies: bool):
    def run(frames):
        for frame in frames:
            lengths = frame["__text"].str.len().to_numpy()
            group = np.cumsum(lengths) // _BATCH_CHARS
            for _, part in frame.groupby(group, sort=False):
                texts = part["__text"].tolist()
                keys, lines = part["__key"].tolist(), part["__line"].tolist()
                seen, out = (-1, None), []
                for t, p, s, e, own, words in cut_texts(texts, limit, overlap):
                    if s == 0 and e == len(texts[t]):
                        first, last = lines[t], lines[t] + texts[t].count("\n", 0, max(0, e - 1))
                    else:
                        if seen[0] != t:
                            seen = (t, _lines(texts[t]))
                        first = lines[t] + int(np.searchsorted(seen[1], s))
                        last = lines[t] + int(np.searchsorted(seen[1], max(s, e - 1)))
                    out.append((keys[t], p, first, last, s, e, own, words) + ((texts[t][s:e],) if bodies else ()))
                yield pd.DataFrame(out, columns=["key", "piece", "line_start", "line_end", "start", "end", "own_start", "words"] + ["text"] * bodies)

    return run


def pieces(df: DataFrame, key: str = "id", text: str = "text", line: str = "line_start", limit: int = LIMIT, overlap: int = OVERLAP, bodies: bool = True) -> DataFrame:
    """Consecutive pieces of every text within the limit: ``key``, ``piece`` from 0, its lines, its characters
    ``start`` to ``end``, the first character that repeats nothing (``own_start``), its words and its ``text``.

    No shuffle: each text is cut where it is read.  ``distinct_pieces`` takes repeated rows out.
    """
    kind = df.schema[key].dataType.simpleString()
    narrow = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.coalesce(F.col(line), F.lit(1)).cast("long").alias("__line"), F.col(text).alias("__text"))
    schema = f"key {kind}, piece int, line_start long, line_end long, start long, end long, own_start long, words long" + (", text string" if bodies else "")
    return narrow.mapInPandas(_pieces(limit, overlap, bodies), schema)


def distinct_pieces(df: DataFrame, key: str = "id", **options) -> DataFrame:
    """``pieces`` with every (key, piece) once, as repeated rows would repeat theirs."""
    return pieces(df, key, **options).dropDuplicates(["key", "piece"])
