"""Byte-pair tokens as a column, from a file of ranks: windows of so many tokens, as a model counts them.

A token is a run of bytes and need not be whole characters.  In a column it is text with a
character for each byte (0 to 255), so tokens can be counted, sliced and joined by the
built-in functions; :func:`as_text` turns joined tokens into the text that they are, with
U+FFFD where a window cuts a character, as a decoder has it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token: a line each, the token in base 64 and its rank (some ten thousands: bounded by the vocabulary)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_pair_tokens(ranks: dict[bytes, int], pattern: str) -> Callable[[Column], Column]:
    """A function from a text column to its tokens; ``pattern`` splits a text before pairs are merged.  No text has no tokens."""

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        said = {rank: token.decode("latin-1") for token, rank in ranks.items()}
        for batch in batches:
            yield pd.Series([[said[i] for i in encoding.encode_ordinary(t)] if t else [] for t in batch])

    return tokens


def as_text(joined: Column) -> Column:
    """Joined tokens as text."""
    return F.make_valid_utf8(F.encode(joined, "ISO-8859-1").cast("string"))
