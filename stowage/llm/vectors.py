"""Vector columns as packed rows for numpy tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import row_seq


def finite(vec: Column) -> Column:
    """True where the vector is there and holds no null, NaN or infinite component."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def finite_rows(vectors: DataFrame, id_col: str, vec_col: str, **others: Column) -> DataFrame:
    """(id, seq, others..., v array<double>) of the rows that have an id and a finite vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), row_seq().alias("seq"),
                          *[c.alias(n) for n, c in others.items()], F.col(vec_col).alias("v"))
    return rows.where(F.col("id").isNotNull() & finite(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list<double> column as a matrix; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims)[None, :] < n[:, None]] = flat
    return out
