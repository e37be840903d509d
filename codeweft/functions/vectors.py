"""Dense-vector column functions over Arrow batches (one numpy call per batch)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def as_matrix(column, dtype=np.float64) -> np.ndarray:
    """Rows of an Arrow list column (no nulls) as one dense matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.empty((0, 0), dtype)
    if flat.size % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1).astype(dtype, copy=False)


def l2_distance(embedding: Column, query) -> Column:
    """L2 distance of each row's vector to one fixed query vector."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def distance(batch: pa.Array) -> pa.Array:
        known = batch.is_valid()
        rows = as_matrix(batch.filter(known))
        out = np.full(len(batch), np.nan)
        if len(rows):
            out[known.to_numpy(zero_copy_only=False)] = np.sqrt(((rows - target) ** 2).sum(axis=1))
        return pa.array(out, mask=np.isnan(out))

    return distance(embedding)


def cos_from_distance(distance: Column) -> Column:
    """Unit vectors: cos = 1 - d^2 / 2."""
    return F.lit(1.0) - distance * distance / F.lit(2.0)


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string; built on the driver, carried by closures."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
