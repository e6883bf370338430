"""Vectors with integer components, for the operators that work on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(embedding: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(embedding).isNotNull() & F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def floored(embedding: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def width_of(df: DataFrame, column: str = "w") -> int:
    return df.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one width: shorter ones are filled with 0, what lies beyond is left out."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row, starts = np.repeat(np.arange(len(length)), length), np.concatenate([[0], np.cumsum(length)[:-1]])
    col = np.arange(len(flat)) - np.repeat(starts, length)
    out = np.zeros((len(length), width), np.int64)
    inside = col < width
    out[row[inside], col[inside]] = flat[inside]
    return out
