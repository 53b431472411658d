"""Full-text search by BM25 over postings, for batches of queries.

A query is a Boolean expression over phrases: words side by side must all occur, ``OR``, ``AND`` and ``NOT`` in
capitals combine, ``a_b`` is a phrase of adjacent tokens within one field, and a star lets the last token of a phrase
be a prefix.  Queries are parsed on the driver into phrases and a disjunction of conjunctions over them; texts are
only ever read through postings, which ``postings`` builds once and a store can keep.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.errors import SearchError
from seekspark.functions.text import ACCENTED, UNACCENTED, tokens
from seekspark.shared import cut

BROADCAST_ROWS, FEW_WORDS = 50_000, 64


def sanitise(query: str) -> str:
    """The query reduced to words of letters, digits and underscores with at most one trailing star."""
    out = []
    for word in re.sub(r"[^A-Za-z0-9_*]+", " ", query).split():
        bare = word.replace("*", "")
        if bare:
            out.append(bare + "*" * word.endswith("*"))
    return " ".join(out)


def phrase(word: str) -> tuple[tuple[str, ...], bool]:
    """(tokens, whether the last is a prefix) of one word of a sanitised query."""
    folded = word.lower().translate(str.maketrans(ACCENTED, UNACCENTED))
    return tuple(t for t in re.split(r"[^a-z0-9]+", folded) if t), word.endswith("*")


def parse(query: str) -> tuple[list[tuple[tuple[str, ...], bool]], list[frozenset]]:
    """(phrases, conjunctions): a conjunction is a set of (phrase number, wanted).

    Binding from tightest: words side by side, NOT, AND, OR.
    """
    words = query.split()
    phrases: list = []
    at = 0

    def fail():
        raise SearchError(f"syntax error in query {query!r}", "SEARCH_FAILED")

    def side_by_side():
        nonlocal at
        got = []
        while at < len(words) and words[at] not in ("AND", "OR", "NOT"):
            p = phrase(words[at])
            if p not in phrases:
                phrases.append(p)
            got.append((phrases.index(p), True))
            at += 1
        if not got:
            fail()
        return [frozenset(got)]

    def both(a, b):
        return [x | y for x in a for y in b if not any((n, not w) in x for n, w in y)]

    def negated(a):
        out = [frozenset()]
        for conjunction in a:
            out = [o | {(n, not w)} for o in out for n, w in conjunction if (n, w) not in o]
        return out

    def without():
        nonlocal at
        left = side_by_side()
        while at < len(words) and words[at] == "NOT":
            at += 1
            left = both(left, negated(side_by_side()))
        return left

    def every():
        nonlocal at
        left = without()
        while at < len(words) and words[at] == "AND":
            at += 1
            left = both(left, without())
        return left

    def some():
        nonlocal at
        left = every()
        while at < len(words) and words[at] == "OR":
            at += 1
            left = left + every()
        return left

    conjunctions = some()
    if at < len(words):
        fail()
    return phrases, conjunctions


def postings(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """((key, field, token, position) for every token, (key, length) for every row); nothing is dropped."""
    listed = F.array(*[F.struct(F.lit(i).alias("field"), tokens(f).alias("tokens")) for i, f in enumerate(fields)])
    split = df.select(F.col(key).alias("key"), F.explode(listed).alias("f")).select("key", "f.field", F.posexplode("f.tokens").alias("position", "token"))
    lengths = df.select(F.col(key).alias("key"), sum((F.size(tokens(f)) for f in fields), F.lit(0)).cast("long").alias("length"))
    return split, lengths


def vocabulary(queries) -> tuple[list[str], list[str]]:
    """(tokens, beginnings of tokens) that sanitised queries ask for."""
    exact, starts = set(), set()
    for text in queries:
        for parts, prefix in parse(text)[0] if text else []:
            exact.update(parts[:-1] if prefix else parts)
            starts.update(parts[-1:] if prefix else ())
    return sorted(exact), sorted(starts)


def asked_for(token, exact: list[str], starts: list[str]):
    wanted = token.isin(exact) if exact else F.lit(False)
    for s in starts:
        wanted = wanted | token.startswith(s)
    return wanted


def scanned(df: DataFrame, key: str, fields: list[str], queries) -> DataFrame:
    """(key, length, hits) in one pass over the texts; hits are (field, position, token) of the tokens asked for."""
    exact, starts = vocabulary(queries)
    split = df.select(F.col(key).alias("key"), *[tokens(f).alias(f"t{i}") for i, f in enumerate(fields)])

    def kept(i):
        every = F.transform(f"t{i}", lambda t, n: F.struct(F.lit(i).alias("field"), n.alias("position"), t.alias("token")))
        return F.filter(every, lambda h: asked_for(h["token"], exact, starts))

    found = F.concat(*[kept(i) for i in range(len(fields))])
    return split.select("key", sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0)).cast("long").alias("length"), found.alias("hits"))


def ranked_few(slim: DataFrame, queries: dict[int, str], limit: int) -> DataFrame:
    """As ``ranked``, for a few queries over (key, length, hits): everything but the statistics and the cut to
    ``limit`` happens within a row."""
    parsed = {q: parse(t) for q, t in queries.items() if t}
    phrases = list(dict.fromkeys(p for ps, _ in parsed.values() for p in ps))
    number = {p: n for n, p in enumerate(phrases)}

    def same(token, parts, prefix, i):
        return token.startswith(parts[i]) if prefix and i == len(parts) - 1 else token == parts[i]

    def times(parts, prefix):
        if not parts:
            return F.lit(0)

        def follows(h, i):
            return F.exists("hits", lambda g: (g["field"] == h["field"]) & (g["position"] == h["position"] + i) & same(g["token"], parts, prefix, i))

        def begins(h):
            fits = same(h["token"], parts, prefix, 0)
            for i in range(1, len(parts)):
                fits = fits & follows(h, i)
            return fits

        return F.size(F.filter("hits", begins))

    counted = cut(slim.select("key", "length", *[times(*p).alias(f"f{n}") for n, p in enumerate(phrases)]))
    stats = counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{n}") > 0).alias(f"n{n}") for n in range(len(phrases))])
    k1, b = V.BM25_K1, V.BM25_B

    def part(n):
        f, idf = F.col(f"f{n}"), F.log((F.col("rows") - F.col(f"n{n}") + 0.5) / (F.col(f"n{n}") + 0.5))
        weight = F.when(idf <= 0, F.lit(V.LEAST_IDF)).otherwise(idf)
        return F.when(f > 0, weight * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("mean")))).otherwise(0.0)

    every = []
    for q, (ps, conjunctions) in parsed.items():
        fits = F.lit(False)
        for conjunction in conjunctions:
            held = F.lit(True)
            for n, wanted in conjunction:
                f = F.col(f"f{number[ps[n]]}")
                held = held & (f > 0 if wanted else f == 0)
            fits = fits | held
        score = sum((part(number[p]) for p in ps), F.lit(0.0))
        every.append(F.struct(F.lit(q).cast("long").alias("query_id"), fits.alias("fits"), score.alias("bm25")))
    any_hit = F.greatest(*[F.col(f"f{n}") for n in range(len(phrases))], F.lit(0)) > 0
    scored = counted.where(any_hit).join(F.broadcast(stats)).select("key", F.explode(F.filter(F.array(*every), lambda x: x["fits"])).alias("x")).select("x.query_id", "key", "x.bm25")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "key"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(positions: DataFrame, lengths: DataFrame, queries: dict[int, str], limit: int) -> DataFrame:
    """(query_id, key, bm25, place) of the ``limit`` best rows of each sanitised query; empty queries give none."""
    spark = positions.sparkSession
    terms, wanted, numbers = [], [], {}
    for q, text in queries.items():
        if not text:
            continue
        phrases, conjunctions = parse(text)
        ids = []
        for p in phrases:
            ids.append(numbers.setdefault(p, len(numbers)))
        wanted += [(q, c, ids[n], w) for c, conjunction in enumerate(conjunctions) for n, w in conjunction]
        wanted += [(q, -1, i, True) for i in ids]
    for (parts, prefix), number in numbers.items():
        terms += [(number, i, t, prefix and i == len(parts) - 1, len(parts)) for i, t in enumerate(parts)]
    term_rows = spark.createDataFrame(terms, "phrase int, offset int, token string, prefix boolean, parts int")
    want_rows = spark.createDataFrame(wanted, "query_id long, conjunction int, phrase int, wanted boolean")
    exact, starts = vocabulary(queries.values())
    read = positions.where(asked_for(F.col("token"), exact, starts))
    t = _small(term_rows, len(terms)).withColumnRenamed("token", "term")
    same = (F.col("token") == F.col("term")) & ~F.col("prefix")
    begun = F.col("prefix") & F.col("token").startswith(F.col("term"))
    hits = read.join(t, same)
    if starts:
        hits = hits.unionByName(read.join(t.where("prefix"), begun))
    found = hits.groupBy("phrase", "key", "field", (F.col("position") - F.col("offset")).alias("start"), "parts").agg(F.count_distinct("offset").alias("n")).where("n = parts")
    counts = found.groupBy("phrase", "key").agg(F.count(F.lit(1)).alias("f"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"))
    rows_with = counts.groupBy("phrase").agg(F.count(F.lit(1)).alias("with"))
    idf = F.log((F.col("rows") - F.col("with") + 0.5) / (F.col("with") + 0.5))
    weights = rows_with.join(F.broadcast(corpus)).select("phrase", "mean", F.when(idf <= 0, F.lit(V.LEAST_IDF)).otherwise(idf).alias("idf"))
    k1, b = V.BM25_K1, V.BM25_B
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = counts.join(_small(weights, len(numbers)), "phrase").join(lengths, "key").select("phrase", "key", part.alias("part"))
    by_query = scored.join(_small(want_rows, len(wanted)), "phrase")
    bm25 = by_query.where("conjunction = -1").groupBy("query_id", "key").agg(F.sort_array(F.collect_list(F.struct("phrase", "part"))).alias("parts"))
    bm25 = bm25.select("query_id", "key", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("bm25"))
    sizes = want_rows.where("conjunction >= 0").groupBy("query_id", "conjunction").agg(F.count_if("wanted").alias("size"))
    met = by_query.where("conjunction >= 0").groupBy("query_id", "conjunction", "key").agg(F.count_if("wanted").alias("met"), F.count_if(~F.col("wanted")).alias("against"))
    fits = met.join(_small(sizes, len(wanted)), ["query_id", "conjunction"]).where("met = size and against = 0").select("query_id", "key").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "key"))
    return bm25.join(fits, ["query_id", "key"]).withColumn("place", place).where(F.col("place") <= limit)


def search(corpus: DataFrame, queries: dict[int, str], limit: int, language: str | None = None, order: str = "reference", stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) over name, text and parent of the chunks in ``corpus`` (id, language, ...).

    ``stored`` are the postings and lengths of an index; without them the texts are scanned for the words asked for,
    once if there are few.

    The score 1 / (1 + bm25) falls as the match gets better; in the order ``reference`` results go by that score
    downwards, in the order ``bm25`` the best match is first.  With a language three times as many are fetched before
    the others are dropped.
    """
    clean = {q: sanitise(t) for q, t in queries.items()}
    wide = limit * 3 if language else limit
    fields = ["name", "text", "parent"]
    if stored is None and 0 < sum(len(t.split()) for t in clean.values()) <= FEW_WORDS:
        fetched = ranked_few(scanned(corpus, "id", fields, clean.values()), clean, wide)
    else:
        fetched = ranked(*(stored or postings(corpus, "id", fields)), clean, wide)
    if language:
        fetched = fetched.join(corpus.where(F.col("language") == language).select(F.col("id").alias("key")), "key", "left_semi")
    scored = fetched.withColumn("score", 1 / (1 + F.col("bm25")))
    by = [F.desc(F.round("score", 9)), "place"] if order == "reference" else ["place"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", F.col("key").alias("chunk_id"), "score", "rank")
