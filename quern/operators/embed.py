"""Embedding of texts in batches, with a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH = 24


def hashed_terms(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """The default: a unit vector of signed term hashes."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()

    return embed


def embed_batches(df: DataFrame, column: str, fn: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64, batch: int = BATCH) -> DataFrame:
    """Adds ``embedding``; texts go to ``fn`` in batches, in order, and a vector of a wrong size or with a value that isn't finite is an error."""
    fn = fn or hashed_terms(dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import math

        for frame in frames:
            vectors: list[list[float]] = []
            for i in range(0, len(frame), batch):
                vectors += fn(frame[column].iloc[i : i + batch].tolist())
            if len(vectors) != len(frame) or any(len(x) != dim or not all(map(math.isfinite, x)) for x in vectors):
                raise ValueError(f"an embedding isn't {dim} finite numbers")
            yield frame.assign(embedding=vectors)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
