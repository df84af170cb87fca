"""Embeddings of text by a model that the caller injects; without one, a deterministic hash embedder.

The only Python on executors outside the training-data operators: a model is not a Column expression. It
is loaded once for each task, and texts reach it in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024

Model = Callable[[list[str]], "np.ndarray"]


def hash_model(dimensions: int = DIMENSIONS) -> Model:
    """Signed hashes of the words, scaled to length one; the zero vector for a text without words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return embed


def embed_column(load: Callable[[], Model] | None = None, dimensions: int = DIMENSIONS):
    """pandas UDF text -> array<float>; ``load`` makes the model in the task. Null texts embed as empty ones."""

    @F.pandas_udf("array<float>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else hash_model(dimensions)
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return udf


def embed_chunks(chunks: DataFrame, load: Callable[[], Model] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """``chunks`` (content) with an embedding."""
    return chunks.withColumn("embedding", embed_column(load, dimensions)("content"))
