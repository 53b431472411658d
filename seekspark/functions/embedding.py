"""Embedders: texts to vectors, behind one interface."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark import values as V
from seekspark.errors import IndexingError


class Embedder(Protocol):
    """Texts to vectors of a fixed size; ``query`` says that the texts are questions."""

    name: str
    dimensions: int

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]: ...


class HashingEmbedder:
    """Words and parts of names hashed into signed slots, at length one; needs no model and no network."""

    name = "local"

    def __init__(self, dimensions: int = V.EMBEDDING_SIZE):
        self.dimensions = dimensions

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in re.findall(r"[^\W\d_]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text or "")):
                digest = hashlib.blake2b(word.lower().encode(), digest_size=8).digest()
                slot = int.from_bytes(digest[:7], "little")
                row[slot % self.dimensions] += 1.0 if digest[7] & 1 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0).tolist()


class HttpEmbedder:
    """An embedder behind HTTPS.  ``transport(url, headers, body)`` returns (status, decoded answer); status 429 is
    tried again three times after 0.5, 1 and 2 seconds, any other failure raises."""

    # Fixed values.
    SERVICES = {"voyage": ("https://api.voyageai.com/v1/embeddings", "voyage-code-3", 1024), "openai": ("https://api.openai.com/v1/embeddings", "text-embedding-3-large", 1024)}

    def __init__(self, name: str, key: str, transport: Callable, dimensions: int | None = None, pause: Callable[[float], None] = time.sleep):
        self.name, self.key, self.transport, self.pause = name, key, transport, pause
        self.url, self.model, default = self.SERVICES[name]
        self.dimensions = dimensions or default

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out: list = []
        for at in range(0, len(texts), V.EMBED_BATCH):
            body = {"model": self.model, "input": texts[at : at + V.EMBED_BATCH]}
            body |= {"input_type": "query" if query else "document"} if self.name == "voyage" else {"dimensions": self.dimensions}
            for attempt in range(4):
                status, said = self.transport(self.url, {"Authorization": f"Bearer {self.key}"}, body)
                if status != 429 or attempt == 3:
                    break
                self.pause(0.5 * 2**attempt)
            if status != 200:
                raise IndexingError(f"{self.name} answered with status {status}", "EMBEDDER_FAILED")
            out += [x["embedding"] for x in sorted(said["data"], key=lambda x: x["index"])]
        return out


def embedder(provider: str = "local", dimensions: int = V.EMBEDDING_SIZE, key: str = "", transport: Callable | None = None) -> Embedder:
    """The embedder that settings name."""
    if provider == "local":
        if dimensions != V.EMBEDDING_SIZE:
            raise IndexingError(f"the local embedder has {V.EMBEDDING_SIZE} dimensions", "CONFIG_INVALID")
        return HashingEmbedder(dimensions)
    if provider not in HttpEmbedder.SERVICES:
        raise IndexingError(f"unknown embedder {provider}", "CONFIG_INVALID")
    if not key or transport is None:
        raise IndexingError(f"{provider} needs a key and a transport", "EMBEDDER_FAILED")
    return HttpEmbedder(provider, key, transport, dimensions)


def prepared(path, parent, text) -> Column:
    """The text to embed for a chunk: path, parent if there is one, text, on lines of their own."""
    named = F.col(parent) if isinstance(parent, str) else parent
    return F.concat_ws("\n", path, F.when(named != "", named), text)


def embedded(df: DataFrame, key: str, text: str, model: Embedder) -> DataFrame:
    """(chunk_id, vector) for every row; each Arrow batch goes to the embedder in one piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = ["" if t is None else t for t in frame["__text"]]
            yield pd.DataFrame({"chunk_id": frame["__key"], "vector": model.embed(texts)})

    return df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInPandas(run, "chunk_id long, vector array<float>")
