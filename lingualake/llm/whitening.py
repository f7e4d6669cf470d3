"""Whitening of embeddings by merging singular value decompositions up a tree.

Entries become whole numbers, and every distinct vector counts once. Each task decomposes its centred vectors batch
by batch and keeps all singular values, the right vectors and the exact sums of the entries. Two such summaries
merge into that of their union: the rows of both (singular value times vector) and one more row, the difference of the
means times sqrt(n1 n2 / (n1 + n2)), are decomposed again. Nothing is cut off, so the merged values are those of
all vectors at once. Spark merges FAN summaries at a time until one is left; each is at most dimension**2 numbers.

Cases: null vectors, vectors with null or non-finite entries and those of an unusual length have no rows (see vectors).
Repeated vectors count once in the fit and get rows each; equal eigenvalues are ordered arbitrarily. A component
without variance (all vectors equal, say) has null as `whitened`, 0 as `explained` and no part in `identity_error`, which is
null if no component has any. An empty table gives no rows. Other columns are ignored. Deviations over 2**63 raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import lists, matrix, whole_numbers

SCALE = 256
#: Summaries that one task merges.
FAN = 16
#: Singular values under this share of the largest are rounding errors.
NOTHING = 1e-12
_SUMMARY = "node int, n bigint, sums array<string>, singular array<double>, vectors array<double>"


@dataclass(frozen=True)
class Summary:
    """Of `n` vectors: the exact sums of their entries, and what their centred matrix decomposes to."""

    n: int
    sums: tuple[int, ...]
    singular: np.ndarray
    vectors: np.ndarray

    @property
    def eigenvalues(self) -> np.ndarray:
        """Those of the covariance, one for each dimension, falling."""
        kept = np.where(self.singular > NOTHING * self.singular.max(initial=0), self.singular, 0.0)
        return np.pad(kept**2 / self.n, (0, len(self.sums) - len(kept)))


def summary(x: np.ndarray) -> Summary:
    """The summary of a matrix of whole numbers, a vector in each row."""
    sums = [int(s) for s in x.sum(axis=0, dtype=object)] if len(x) * np.abs(x).max(initial=0) >= 1 << 62 else x.sum(axis=0).tolist()
    mean = np.array([s / len(x) for s in sums])
    _, singular, vectors = np.linalg.svd(x - mean, full_matrices=False)
    return Summary(len(x), tuple(sums), singular, vectors)


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of the vectors of both."""
    apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    rows = np.vstack([a.singular[:, None] * a.vectors, b.singular[:, None] * b.vectors, np.sqrt(a.n * b.n / (a.n + b.n)) * apart])
    _, singular, vectors = np.linalg.svd(rows, full_matrices=False)
    return Summary(a.n + b.n, tuple(s + t for s, t in zip(a.sums, b.sums, strict=True)), singular, vectors)


def _row(node: int, s: Summary) -> pa.RecordBatch:
    columns = [pa.array([node], pa.int32()), pa.array([s.n], pa.int64()), pa.array([[str(x) for x in s.sums]]), pa.array([s.singular.tolist()], pa.list_(pa.float64())), pa.array([s.vectors.reshape(-1).tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["node", "n", "sums", "singular", "vectors"])


def _read(row: dict) -> Summary:
    sums = tuple(map(int, row["sums"]))
    return Summary(row["n"], sums, np.array(row["singular"], float), np.array(row["vectors"], float).reshape(-1, len(sums)))


def _union(found: Iterator[Summary]) -> Summary | None:
    out = None
    for s in found:
        out = s if out is None else merged(out, s)
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = _union(summary(matrix(b.column("x"))) for b in batches if b.num_rows)
    if whole:
        yield _row(TaskContext.get().partitionId(), whole)


def _merge(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["node"])
    return pa.Table.from_batches([_row(rows[0]["node"] // FAN, _union(map(_read, rows)))])


def fit(distinct: DataFrame) -> Summary | None:
    """The summary of a table of vectors `x`; None if it is empty."""
    level = staged(distinct.mapInArrow(_summaries, _SUMMARY))
    nodes = level.agg(F.max("node")).first()[0]
    while nodes:
        level = level.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(_merge, _SUMMARY)
        nodes //= FAN
    last = level.first()
    return _read(last.asDict()) if last else None


def _columns(model: Summary, components: int) -> np.ndarray:
    """The matrix that a centred vector times n is multiplied with; zeros where a component has no variance."""
    e = model.eigenvalues[:components]
    v = np.zeros((len(e), len(model.sums)))
    have = min(len(e), len(model.vectors))
    v[:have] = model.vectors[:have]
    return np.divide(v, np.sqrt(e)[:, None], out=np.zeros_like(v), where=e[:, None] > 0).T


def _centred(x: np.ndarray, model: Summary) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the sum of its squares for each row; exact."""
    largest = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
    kind = np.int64 if largest < 1 << 63 and len(model.sums) * largest**2 < 1 << 63 else object
    apart = x.astype(kind) * model.n - np.array(model.sums, dtype=kind)
    return apart, (apart**2).sum(axis=1)


def _whiten(x: np.ndarray, model: Summary, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart, deviation = _centred(x, model)
    return (apart / model.n).astype(float) @ columns, deviation


def identity_error(distinct: DataFrame, model: Summary, components: int) -> float | None:
    """How far the covariance of the whitened vectors is from the identity, at its farthest entry."""
    columns = _columns(model, components)
    columns = columns[:, model.eigenvalues[:components] > 0]
    names = [f"w{k}" for k in range(columns.shape[1])]
    if not names:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in _whiten(matrix(batch.column("x")), model, columns)[0].T], names)

    rows = distinct.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
    found = rows.agg(*(F.covar_pop(names[a], names[b]).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def _rows(model: Summary, components: int, error: float | None):
    columns = _columns(model, components)
    e, total = model.eigenvalues[:components], model.eigenvalues.sum()
    k = len(e)
    explained = e / total if total > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white, deviation = _whiten(matrix(batch.column("x")), model, columns)
            n = len(white)
            out = {
                "id": batch.column("id").take(pa.array(np.repeat(np.arange(n), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                "n": pa.array(np.full(n * k, model.n)),
                "deviation": pa.array([d for d in deviation.tolist() for _ in range(k)], pa.int64()),
                "whitened": pa.array(white.reshape(-1), mask=np.tile(e <= 0, n)),
                "explained": pa.array(np.tile(explained, n)),
                "identity_error": pa.array([error] * (n * k), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), a row for each component of each vector that counts.

    Of fewer dimensions than `components` there are as many rows as dimensions. All vectors are read twice, the distinct ones shuffled once.
    """
    rows = whole_numbers(df, scale, id_col, vector_col)
    distinct = staged(rows.select("x").distinct())
    model = fit(distinct)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], kind)
    return rows.mapInArrow(_rows(model, components, identity_error(distinct, model, components)), kind)
