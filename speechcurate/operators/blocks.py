"""Blocked pair computations: bounded groups of rows meet, pairs are never emitted."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows per block; a pair of blocks gives one distance matrix, computed in slices.
BLOCK_ROWS = 4_096
SLICE_ROWS = 512


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of a float array column as a float64 matrix."""
    return np.stack(vectors.to_numpy()).astype(np.float64)


def packed_type(points: DataFrame, vector: str) -> str:
    """Type of the numbers of a packed block: floats stay floats, all else is double."""
    return "float" if points.schema[vector].dataType.elementType.simpleString() == "float" else "double"


def flat_numbers(vectors: pa.ChunkedArray, number: str) -> np.ndarray:
    """The numbers of a block's vectors, one vector after the other."""
    return vectors.combine_chunks().flatten().cast(pa.float32() if number == "float" else pa.float64()).to_numpy(zero_copy_only=False)


def squared_slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Squared distances of some rows of ``a`` at a time to all of ``b``, with the sum of squared norms."""
    bb = np.einsum("ij,ij->i", b, b)
    for start in range(0, len(a), SLICE_ROWS):
        part = a[start:start + SLICE_ROWS]
        norms = np.einsum("ij,ij->i", part, part)[:, None] + bb[None, :]
        yield start, norms - 2.0 * (part @ b.T), norms


def block_size(rows: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Rows per block: never above the bound, and enough pairs of blocks for all cores."""
    if rows < 1:
        return 1
    blocks = max(math.ceil(rows / block_rows), math.ceil(math.sqrt(2 * parallelism)))
    return math.ceil(rows / blocks)


def task_width(spark: SparkSession) -> int:
    """Tasks that keep all cores busy."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
