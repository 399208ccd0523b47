"""Counting and cutting by a public tokenizer; its vocabulary file stays where it is installed (a path)."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "byte_bpe_multi_50k.tiktoken"


@cache
def encoding(path: str | None = None):
    """The byte-level BPE of the file at ``path`` (default: the installed multilingual one); once in each process."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(DEFAULT), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column | str, path: str | None = None) -> Column:
    """Tokens of each text; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in texts], dtype="Int64")

    return F.pandas_udf(run, "bigint")(text)
