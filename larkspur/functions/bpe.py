"""Token counts by a BPE vocabulary file, as a hook for the chunkers.

The file is one of the tokenizers library (``.json``) or one of ranks (``.tiktoken``, with its splitting pattern); its path has to be
readable on the executors. Without a vocabulary the chunkers take a quarter of the bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """Counts of texts, one loaded vocabulary per Python worker; special tokens in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in loaded.encode_batch(texts, add_special_tokens=False)]


def bpe_counts(path: str, pattern: str | None = None) -> Callable[[Column], Column]:
    """array<string> -> array<long>: tokens of each piece; null pieces count none."""

    @F.pandas_udf("array<long>")
    def count(pieces: pd.Series) -> pd.Series:
        counted = encoder(path, pattern)
        return pieces.map(lambda some: None if some is None else counted([p or "" for p in some]))

    return count
