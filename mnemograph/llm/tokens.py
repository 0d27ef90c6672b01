"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern that belongs to that vocabulary
SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once for a Python worker."""
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = DEFAULT_VOCABULARY) -> Callable[[Column], Column]:
    """A column function that counts the tokens of whole texts; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return count
