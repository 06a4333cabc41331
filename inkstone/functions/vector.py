"""Vector expressions, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

EPSILON = 1e-8


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _d(x: Column) -> Column:
    return x.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def closeness(squared: Column) -> Column:
    """1 / (1 + d²)."""
    return 1 / (1 + squared)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small constant added to each norm, so zero vectors give 0."""
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y)) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def hashed_words(texts: pd.Series, dim: int) -> pd.Series:
    """The vectors of hash_embedding for a batch of texts; a word that occurs in it often is hashed once."""
    import xxhash

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            self[word] = at = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % dim
            return at

    out, buckets = [], Buckets()
    for t in texts:
        v = np.bincount([buckets[w] for w in (t or "").split()], minlength=dim).astype(np.float64)
        length = np.sqrt(v @ v)
        out.append((v / length if length else v).astype(np.float32))
    return pd.Series(out)


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Counts of the text's words by hash bucket, of length 1; zeros for a text without words or NULL.

    A vectorised function: as nested array expressions it costs dim times the words of a text.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return hashed_words(texts, dim)

    return embed(text)
