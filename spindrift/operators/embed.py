"""Embedding of texts: equal texts once, cached vectors first. The embedder is a parameter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..config import SETTINGS
from ..functions.text import truncate, words
from .incremental import embedding_lookup

#: Makes a vector column of a text column: a Column expression, or a pandas function that calls a model for each batch.
Embedder = Callable[[Column], Column]


@F.pandas_udf(ArrayType(DoubleType()))
def _cells(words_of: pd.Series, digits: pd.Series) -> pd.Series:
    n = 16 ** int(digits.iloc[0]) if len(digits) else 1
    used = n.bit_length() // 4
    counts = np.zeros((len(words_of), n))
    for row, own in enumerate(words_of):
        at = [int(hashlib.md5(w.encode()).hexdigest()[:used], 16) for w in own]
        counts[row] = np.bincount(at, minlength=n) if at else 0
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(counts / np.where(norms > 0, norms, 1)))


def hashed_words(text: Column, digits: int = 1) -> Column:
    """A vector of length one that counts words by the first hex digits of their hashes (16 cells a digit); zeros without words."""
    return _cells(words(text), F.lit(digits))


def embed(texts: DataFrame, cache: DataFrame, model: str, embedder: Embedder = hashed_words, most: int = SETTINGS.embed_max) -> tuple[DataFrame, DataFrame]:
    """(texts with text_hash, vector, hit; fresh rows for the cache: text_hash, vector).

    A text is cut to what the model takes, a blank one is a space. Only different texts that the cache misses are embedded, once each,
    and the vectors are joined back by hash. cache has text_hash, vector, one row a hash.
    """
    held = embedding_lookup(texts.withColumns({"__full": F.col("text"), "text": truncate(F.col("text"), most)}), cache, model)
    missed = held.where("not hit").select("text_hash", "text").dropDuplicates(["text_hash"])
    fresh = missed.select("text_hash", embedder(F.col("text")).alias("vector"))
    joined = held.join(fresh.withColumnRenamed("vector", "__fresh"), "text_hash", "left")
    whole = joined.withColumns({"text": F.col("__full"), "vector": F.coalesce("vector", "__fresh")})
    return whole.select(*texts.columns, "text_hash", "vector", "hit"), fresh
