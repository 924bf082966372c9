"""Vectors of whole numbers: what the operators on embeddings read, and how Arrow columns of them become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(rows: DataFrame, scale: int, vec_id: str, embedding: str, width: int | None = None, **more: Column) -> DataFrame:
    """(vec_id long, vec array<long>, more) of the rows with a vector: components are floor(scale * x), x as double.

    Left out are null vectors, those with a null or non-finite component and, where `width` is given, those of another
    length. A component beyond the range of long raises Spark's overflow error.
    """
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda v: v.cast("double")).alias("x"), *[c.alias(n) for n, c in more.items()])
    broken = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = named.where("x is not null").where(~F.coalesce(broken, F.lit(True)))
    if width is not None:
        sound = sound.where(F.size("x") == width)
    return sound.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vec"), *more)


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of longs as the rows of a matrix, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def exact(x: np.ndarray, y: np.ndarray) -> np.dtype:
    """The type in which sums of products (or of squared differences) of the rows of x and y are whole: doubles, longs, or else Python's numbers."""
    most = 4 * max(x.shape[1], 1) * (float(np.abs(x).max(initial=0)) + 1) * (float(np.abs(y).max(initial=0)) + 1)
    most = max(most, 4 * max(x.shape[1], 1) * (float(np.abs(x).max(initial=0)) + 1) ** 2, 4 * max(y.shape[1], 1) * (float(np.abs(y).max(initial=0)) + 1) ** 2)
    return np.dtype(np.float64) if most < 2**52 else np.dtype(np.int64) if most < 2**62 else np.dtype(object)
