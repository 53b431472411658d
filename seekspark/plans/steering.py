"""Steered searches: a model plans, the engine searches, the model explains; every step works without a model."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from seekspark import values as V
from seekspark.errors import SeekError
from seekspark.plans import understanding as U


class Provider(Protocol):
    """A language model: the answer to a prompt under a system text."""

    name: str

    def chat(self, prompt: str, system: str) -> str: ...


@dataclass
class HttpProvider:
    """A provider behind HTTPS; ``transport(url, headers, body)`` does the call and returns the decoded answer."""

    name: str
    key: str
    transport: Callable[[str, dict, dict], dict]
    model: str = ""

    def chat(self, prompt: str, system: str) -> str:
        if self.name == "gemini":
            model = self.model or "gemini-3-flash-preview"
            body = {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": prompt}]}]}
            said = self.transport(f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", {"x-goog-api-key": self.key}, body)
            return said["candidates"][0]["content"]["parts"][0]["text"]
        if self.name == "openai":
            body = {"model": self.model or "gpt-5-mini", "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            said = self.transport("https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {self.key}"}, body)
            return said["choices"][0]["message"]["content"]
        body = {"model": self.model or "claude-3-5-haiku-latest", "max_tokens": 1024, "system": system, "messages": [{"role": "user", "content": prompt}]}
        said = self.transport("https://api.anthropic.com/v1/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, body)
        return said["content"][0]["text"]


def detect(transport: Callable, explicit: str | None = None, environment=os.environ) -> HttpProvider | None:
    """The provider asked for, or the first whose key is set; none without a key."""
    for name in [explicit] if explicit else V.PROVIDERS:
        key = environment.get(V.PROVIDERS.get(name, ""), "")
        if key:
            return HttpProvider(name, key, transport)
    return None


PLAN_PROMPT = (
    "You choose how to search an index of source code. Answer with one JSON object and nothing else: "
    '{"interpretation": what the question is after, "strategies": [{"strategy": one of "vector", "fts", "ast", "path", "dependency", '
    '"query": the text to give this strategy, "weight": a number from 0 to 1, "reason": why}]}. '
    "vector takes sentences, fts words of the text, ast names of functions and types, path words or globs of file paths. "
    "A strategy may come more than once."
)
EXPLAIN_PROMPT = "You explain search results from source code to a programmer in a few sentences, naming files and symbols. Say so if nothing fits the question."
NOTHING_FOUND = "No results found for this query."
NO_EXPLANATION = "The results could not be explained."


@dataclass
class Steered:
    """A steered search's plan, collected rows, explanation and cost."""

    interpretation: str
    strategies: list[dict]
    results: list
    explanation: str = ""
    tokens: int = 0
    cost: float = 0.0
    stats: dict = field(default_factory=dict)


def tokens_in(text: str) -> int:
    return -(-len(text) // V.CHARS_PER_TOKEN)


def plan_search(provider: Provider, query: str) -> tuple[dict, int]:
    """The plan and its tokens; any failure of the model gives the fallback plan."""
    try:
        said = provider.chat(query, PLAN_PROMPT)
        return U.plan_from(said, query), tokens_in(PLAN_PROMPT) + tokens_in(query) + tokens_in(said)
    except (SeekError, ValueError, KeyError, IndexError, TypeError, OSError):
        return {"interpretation": f"Searching for: {query}", "strategies": U.fallback_plan(query)}, 0


def explain(provider: Provider, query: str, rows: list) -> tuple[str, int]:
    """What the ten best rows show, each with at most 150 characters of its snippet."""
    if not rows:
        return NOTHING_FOUND, 0
    listed = [{"file": r["file"], "lines": list(r["lines"]), "name": r["name"], "type": r["type"], "score": r["score"], "text": (r["snippet"] or "")[:150]} for r in rows[:10]]
    prompt = f"Question: {query}\nResults:\n" + "\n".join(json.dumps(x, ensure_ascii=False) for x in listed)
    try:
        said = provider.chat(prompt, EXPLAIN_PROMPT)
    except (SeekError, ValueError, KeyError, IndexError, TypeError, OSError):
        return NO_EXPLANATION, 0
    return said, tokens_in(EXPLAIN_PROMPT) + tokens_in(prompt) + tokens_in(said)


def ask(query: str, run: Callable[[list[dict]], list], provider: Provider | None = None, explained: bool = True) -> Steered:
    """A question answered in one of three ways: without a provider by the fallback plan, with one by its plan, and
    with its explanation.  ``run`` executes a plan and returns the shown rows."""
    if provider is None:
        plan = U.fallback_plan(query)
        return Steered(f"Searching for: {query}", plan, run(plan))
    plan, used = plan_search(provider, query)
    rows = run(plan["strategies"])
    text, more = explain(provider, query, rows) if explained else ("", 0)
    used += more
    return Steered(plan["interpretation"], plan["strategies"], rows, text, used, used / 1e6 * V.DOLLARS_PER_MILLION)
