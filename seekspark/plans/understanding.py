"""What a query is: its class, weights, symbols, terms, and the plan to search by when no model gives one.

``classified`` works on a column for batches; the rest is plain Python for single queries.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspark import values as V

STRATEGIES = tuple(V.STRATEGY_WEIGHTS)


def kind_of(query: str) -> str:
    """path, symbol, natural_language or keyword, the first that fits."""
    q = query.strip()
    if re.search(V.PATH_QUERY, q, re.I):
        return "path"
    if re.match(V.SYMBOL_QUERY, q):
        return "symbol"
    found = q.lower().split()
    asks = any(w in V.QUESTION_WORDS for w in found)
    return "natural_language" if asks or len(found) >= 4 and any(w in V.PHRASE_WORDS for w in found) else "keyword"


def weights_of(query: str) -> dict[str, float]:
    """Each strategy's weight under the query's class."""
    factors = V.MULTIPLIERS[kind_of(query)]
    return {s: w * factors.get(s, 1.0) for s, w in V.STRATEGY_WEIGHTS.items()}


def classified(query: Column) -> Column:
    """The class of a query column."""
    q = F.trim(F.regexp_replace(query, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", ""))
    found = F.filter(F.split(F.lower(q), r"[ \t\r\n\f]+"), lambda w: w != "")
    asks = F.arrays_overlap(found, F.array(*map(F.lit, V.QUESTION_WORDS)))
    phrase = (F.size(found) >= 4) & F.arrays_overlap(found, F.array(*map(F.lit, V.PHRASE_WORDS)))
    return F.when(q.rlike("(?i)" + V.PATH_QUERY), "path").when(q.rlike(V.SYMBOL_QUERY), "symbol").when(asks | phrase, "natural_language").otherwise("keyword")


def weight(kind: Column, strategy: str) -> Column:
    """The weight of one strategy by a column of classes."""
    base, out = V.STRATEGY_WEIGHTS[strategy], F.lit(None).cast("double")
    for name, factors in V.MULTIPLIERS.items():
        out = F.when(kind == name, F.lit(base * factors.get(strategy, 1.0))).otherwise(out)
    return out


def strategies_for(query: str, asked: list[str] | None, defaults: tuple[str, ...] = ("fts", "ast", "path")) -> list[str]:
    """The strategies to run: those asked for, or the defaults, with vectors for questions in words."""
    if asked is not None:
        return asked
    out = list(defaults)
    return out + ["vector"] if kind_of(query) == "natural_language" and "vector" not in out else out


def symbol_names(query: str) -> list[str]:
    return re.findall(V.SYMBOL_NAMES, query)


def is_path_like(query: str) -> bool:
    return bool(re.search(r"[/*.]", query))


def whole_limit(limit: float) -> int:
    """A limit as a whole number; 0 for negative and endless ones."""
    return max(0, int(limit)) if abs(limit) != float("inf") and limit == limit else 0


def stem(term: str) -> str | None:
    """The short form of a word by the list of stems, else by its suffix if four letters remain."""
    low = term.lower()
    if low in V.STEMS:
        known = V.STEMS[low]
        if known != low:
            return known
    if not re.fullmatch(r"[a-z][a-z0-9_]*", low):
        return None
    return next((low[: -len(s)] for s in V.SUFFIXES if low.endswith(s) and len(low) - len(s) >= 4), None)


def search_terms(query: str) -> str:
    """The words of a question worth searching: dotted names, paths, then words that are no stop words or look like
    code, each with its stem, once and in order; if none is left the longest word, or the query itself."""
    out: dict[str, str] = {}

    def add(term: str) -> None:
        out.setdefault(term.lower(), term)
        if (short := stem(term)) and short != term.lower():
            out.setdefault(short.lower(), short)

    for name in re.findall(r"[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+", query, re.A):
        add(name)
    for word in query.split():
        if "/" in word:
            add(word.rstrip("?!,;"))
    for word in re.sub(r"[^a-zA-Z0-9_.\s/-]", " ", query).split():
        if len(word) >= 2 and word.lower() not in out and (word.lower() not in V.STOP_WORDS or re.match(V.CODE_NAME, word)):
            add(word)
    if out:
        return " ".join(out.values())
    left = [w for w in re.sub(r"[^a-zA-Z0-9_\s]", " ", query).split() if len(w) >= 2]
    return max(left, key=len) if left else query


REASONS = {"vector": "meaning of the question", "fts": "words in the text", "ast": "names of symbols", "path": "words in paths"}


def fallback_plan(query: str) -> list[dict]:
    """The strategies to run without a model: vectors by the question, the others by its terms."""
    terms, by = search_terms(query), weights_of(query)
    return [{"strategy": s, "query": query if s == "vector" else terms, "weight": by[s], "reason": REASONS[s]} for s in ("vector", "fts", "ast", "path")]


def plan_from(answer: str, query: str) -> dict:
    """A model's answer as a plan: its outermost braces as JSON, with the known strategies; anything else gives the
    fallback plan.  Broken JSON raises ValueError."""
    backup = {"interpretation": f"Searching for: {query}", "strategies": fallback_plan(query)}
    found = re.search(r"\{.*\}", answer, re.S)
    if not found:
        return backup
    said = json.loads(found.group())
    listed = said.get("strategies")
    if not said.get("interpretation") or not isinstance(listed, list):
        return backup
    known = [s for s in listed if isinstance(s, dict) and s.get("strategy") in STRATEGIES]
    return {"interpretation": said["interpretation"], "strategies": known} if known else backup
