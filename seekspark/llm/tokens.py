"""Token counts by a public tokenizer, whose vocabulary file is a parameter and never part of this repository."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern this vocabulary splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, built once in a Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text column; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(column: pd.Series) -> pd.Series:
        encode = encoder(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in column], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)
