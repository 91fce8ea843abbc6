"""Reading vectors: what the operators on integer vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of vectors that a task works on at once.
ROWS = 4096


def finite(v: Column) -> Column:
    """Whether a vector is there and has only finite components, at least one."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound, F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """Components of every vector, 0 without vectors; an error if they differ."""
    row = vectors.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if row.low != row.high:
        raise ValueError(f"vectors have from {row.low} to {row.high} components")
    return row.low or 0


def blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, each with its vectors as a float64 matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.astype(np.float64).reshape(-1, d)
