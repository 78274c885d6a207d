"""Token counts by a byte-pair vocabulary, where one is at hand."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_tokens


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def count_tokens_bpe(text: Column, vocabulary: str | None) -> Column:
    """Tokens of whole texts by the vocabulary in a tokenizer file, in Arrow
    batches; null has none.  Without a vocabulary: bytes over 3.8."""
    if vocabulary is None:
        return count_tokens(text)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        found = _tokenizer(vocabulary).encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e) for e in found], dtype="int64")

    return count(text)
