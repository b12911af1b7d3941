"""Vectors as columns: what counts as one, and their passage to workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(name: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    v = F.col(name)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a usable vector; v as doubles only where the column has them."""
    kind = rows.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable("v"))


def lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Each vector in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offs = column.offsets.to_numpy() - column.offsets[0].as_py() if len(column) else np.zeros(1, dtype=np.int64)
    return np.split(values, offs[1:-1]) if len(column) else []


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    own = lists(column)
    return np.stack(own) if own else np.zeros((0, 0))
