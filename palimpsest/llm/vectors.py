"""What the two operators on embeddings share: usable vectors, classes of equal vectors, columns of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding (array of doubles) of the vectors that can be compared.

    Left out are null ids, null, empty and zero vectors, vectors that hold null or non-finite numbers, and those of another length than most have (of
    lengths equally frequent, the largest counts).
    """
    vector = F.col(f"`{embedding}`").cast("array<double>")
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), vector.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    top = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (top["n"] if top else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))
