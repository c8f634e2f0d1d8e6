"""Vector expressions, and the embedder that needs no model file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what is put before a question (not before a passage) when it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


#: Places of a vector that a gram is spread over; 16 are one hash.
PLACES = 16


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def embed_text(text: str | None, dim: int) -> np.ndarray:
    """Hashed words and word pairs with signs, scaled to unit length; the zero vector for no words.

    Each gram is spread over :data:`PLACES` places, so that two different grams meet in a few of them by chance, never in all:
    what they add to a product by chance is a small share of what a gram in common adds."""
    import hashlib

    words = (text or "").lower().split()
    grams = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]
    h = np.frombuffer(b"".join(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=4 * PLACES).digest() for g in grams), "<u4")
    out = np.bincount((h & 0x7FFFFFFF) % dim, weights=np.where(h >> 31, 1.0, -1.0), minlength=dim)
    size = float(np.sqrt(out @ out))
    return out / size if size else out


def embedder(dim: int = 256, model=None, provider: str = "local"):
    """A pandas function text -> vector of ``dim`` numbers; ``model`` makes the function of a list of texts, once a task.

    Only a local provider is known; vectors of another length are an error, as is a model that returns fewer than it was asked for."""
    if provider != "local":
        raise ValueError(f"no embedding provider {provider!r}")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model() if model else (lambda texts: [embed_text(t, dim) for t in texts])
        for batch in batches:
            found = [np.asarray(v, np.float32).tolist() for v in encode(batch.tolist())]
            if len(found) != len(batch) or any(len(v) != dim for v in found):
                raise ValueError(f"the model's vectors are not one of {dim} numbers for each text")
            yield pd.Series(found)

    return embed


def query_text(question: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), question)
