"""What the operators on embeddings share: the rows that count, as whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Larger whole numbers aren't exact as doubles.
LARGEST = 1 << 53


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A list column, all of one length and without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1 if len(column) and len(column[0]) else 0)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.reshape(-1)))


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(matrix(batch.column("x"), np.float64) * scale)
            if x.size and np.abs(x).max() > LARGEST:
                raise ValueError(f"an entry times {scale} is over 2**53")
            columns = [c if n != "x" else lists(x.astype(np.int64)) for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def whole_numbers(df: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """Rows (id, x[, label]) of the vectors that count, each entry as floor(scale * entry).

    Null vectors, those with null or non-finite entries and those of another length than most have (the longer of equally
    frequent lengths counts) are left out. Entries of more than 2**53 / scale raise.
    """
    label = [F.col(label_col).alias("label")] if label_col else []
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"), *label)
    bad = F.exists("x", lambda c: F.isnull(c) | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("x") == (usual["size"] if usual else 0))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" if c != "x" else "x array<bigint>" for c in rows.columns]
    return rows.mapInArrow(_whole(scale), ", ".join(kinds))
