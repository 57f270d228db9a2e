"""Vectors that can take part in comparisons by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_ids(table: DataFrame, *columns: str) -> DataFrame:
    """One row per ``vec_id`` that is not null: of rows that repeat an id the smallest holds."""
    return table.where("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(*columns)).alias("r")).select("vec_id", "r.*")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (scaled by their largest component first, so that squares neither overflow nor vanish)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
