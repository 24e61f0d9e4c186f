"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@cache
def encoding(path: str):
    """The tokenizer of a ranks file, loaded once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str = RANKS) -> DataFrame:
    """(key, *keep, tokens LONG): the token count of the whole text; 0 for NULL and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for texts in batches:
            yield texts.map(lambda t: len(e.encode_ordinary(t)) if t else 0).astype("int64")

    return documents.select(F.col(key).cast("long").alias(key), *keep, count(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
