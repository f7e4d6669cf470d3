"""Codes for vectors: each of their parts becomes the number of the nearest entry of that part's codebook.

The codebooks begin as parts of the first vectors and are moved to the means of what they attract, in whole numbers.
Nearest entries are found through approximations: every coordinate of the entries falls into one of 2**BITS
cells, and for a part that looks for its entry a table holds the least and the greatest squared distance from each
of its coordinates to each cell. Sums of these bound the distance to each entry; only entries whose lower bound is
not above the smallest upper bound are compared in full, with whole numbers.

A round reads the table once. Its tasks hand on at most one row for each entry of each codebook, so the driver gets
`PARTS * ENTRIES` sums, whatever the table's size.

Cases: null vectors, vectors with null or non-finite entries and those of an unusual length have no rows (see vectors). Of
a length that `PARTS` doesn't divide, the first parts are one longer. Of fewer vectors than `ENTRIES` there are fewer
entries. Repeated ids are ordered by vector, null ids come last. Repeated rows count each; null labels form one group.
An empty table gives no rows. Other columns are ignored. Distances that could pass 2**62 raise.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_left_join, staged
from .vectors import matrix, whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a coordinate's cell.
BITS = 4
#: Parts that look for their entries together.
BLOCK = 256


class Cells:
    """One codebook with the cells of its entries' coordinates; a cell holds about as many entries as any other."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, size = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((n, size), np.int64)
        shares = (np.arange(n) << bits) // n
        for d in range(size):
            self.cell[order[:, d], d] = shares
        used = int(shares[-1]) + 1 if n else 0
        first, last = np.searchsorted(shares, np.arange(used)), np.searchsorted(shares, np.arange(used), side="right") - 1
        in_order = np.take_along_axis(entries, order, axis=0)
        self.low, self.high = in_order[first].T[:, :, None], in_order[last].T[:, :, None]

    @cached_property
    def small(self) -> Cells:
        """The same with numbers of 32 bits."""
        own = copy.copy(self)
        own.entries, own.low, own.high = (x.astype(np.int32) for x in (self.entries, self.low, self.high))
        return own

    def _bounds(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest squared distance to each entry, entries by rows."""
        across = np.ascontiguousarray(wanted.T)[:, None, :]
        under, over = self.low - across, across - self.high
        least = np.maximum(np.maximum(under, over), 0) ** 2
        greatest = np.maximum(-under, -over) ** 2
        shape = (len(self.entries), len(wanted))
        low, high, one = np.zeros(shape, wanted.dtype), np.zeros(shape, wanted.dtype), np.empty(shape, wanted.dtype)
        for d in range(wanted.shape[1]):
            low += np.take(least[d], self.cell[:, d], axis=0, out=one, mode="clip")
            high += np.take(greatest[d], self.cell[:, d], axis=0, out=one, mode="clip")
        return low, high

    def _nearest(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self._bounds(wanted)
        row, entry = np.nonzero((low <= high.min(axis=0)).T)
        distance = ((self.entries[entry] - wanted[row]) ** 2).sum(axis=1, dtype=np.int64)
        starts = np.searchsorted(row, np.arange(len(wanted)))
        least = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(wanted)))]], least

    def nearest(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry, the lower of equally near ones, and its squared distance, for each row."""
        largest = int(np.abs(wanted).max(initial=0)) + int(np.abs(self.entries).max(initial=0))
        if wanted.shape[1] * largest**2 >= 1 << 62:
            raise ValueError("a squared distance could pass 2**62")
        if wanted.shape[1] * largest**2 < 1 << 31:  # half the memory to read
            wanted, self = wanted.astype(np.int32), self.small
        found = [self._nearest(wanted[k : k + BLOCK]) for k in range(0, len(wanted), BLOCK)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(x, parts, axis=1)


def _sums(codebooks: list[np.ndarray]):
    """One row (part, entry, n, s0, s1, ...) for each entry that parts of the task's vectors are nearest to."""
    widest = max(c.shape[1] for c in codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros_like(c) for c in codebooks]
        for batch in batches:
            for k, wanted in enumerate(_cut(matrix(batch.column("x")), len(codebooks))):
                entry, _ = cells[k].nearest(wanted)
                counts[k] += np.bincount(entry, minlength=len(counts[k]))
                np.add.at(sums[k], entry, wanted)
        for k, (n, s) in enumerate(zip(counts, sums, strict=True)):
            used = np.flatnonzero(n)
            wide = np.pad(s[used], ((0, 0), (0, widest - s.shape[1])))
            columns = [np.full(len(used), k), used, n[used], *wide.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["part", "entry", "n", *(f"s{d}" for d in range(widest))])

    return run


def moved(rows: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry at the rounded-down mean of the parts that are nearest to it."""
    widest = max(c.shape[1] for c in codebooks)
    names = ["n", *(f"s{d}" for d in range(widest))]
    found = rows.mapInArrow(_sums(codebooks), "part bigint, entry bigint, " + ", ".join(f"{c} bigint" for c in names))
    out = [c.copy() for c in codebooks]
    for r in found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names)).collect():  # at most one for each entry
        size = out[r["part"]].shape[1]
        out[r["part"]][r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(size)]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of a written table (id, x), one for each part; they begin as the parts of the first `entries` ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()
    codebooks = _cut(np.array([r["x"] for r in first], np.int64).reshape(len(first), -1 if first and len(first[0]["x"]) else 0), parts)
    for _ in range(rounds if first else 0):
        codebooks = moved(rows, codebooks)
    return codebooks


def _codes(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        for batch in batches:
            found = [cells[k].nearest(wanted) for k, wanted in enumerate(_cut(matrix(batch.column("x")), len(codebooks)))]
            code = [bytes(c).hex() for c in np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)]
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def coded(rows: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """`rows` (id, label, x) as (id, label, code, error): two hexadecimal digits for each part's entry, and the squared distance."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_codes(codebooks), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def digest(codebooks: list[np.ndarray]) -> str:
    """The SHA-256 of all entries' numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.reshape(-1).tolist()).encode()).hexdigest()


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (id, label, code, error, label_error, codebooks_sha256) of the vectors that count; `label_error` is the error of all rows of the label."""
    rows = staged(whole_numbers(df, scale, id_col, vector_col, label_col))
    codebooks = fit(rows)
    if not len(codebooks[0]):
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return df.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    found = staged(coded(rows, codebooks)).withColumn("_label", F.struct("label"))
    totals = found.groupBy("_label").agg(F.sum("error").alias("label_error"))
    out = salted_left_join(found, totals, "_label", "id")
    return out.select("id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def sql(scale: int = SCALE, rounds: int = ROUNDS) -> str:
    """The rows of encode() with the default numbers of parts and entries, for vectors of one length that 4 divides."""
    steps = f"""
        WITH k AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))), 0) = 0),
        p AS MATERIALIZED (
            SELECT vec_id, label, part, x[CAST(part * len(x) // 4 + 1 AS BIGINT) : CAST((part + 1) * len(x) // 4 AS BIGINT)] AS v FROM k, range(4) r(part)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256),
        b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN f USING (vec_id)),"""
    near = """
        a{0} AS MATERIALIZED (
            SELECT vec_id, label, part, v, min(d) AS d, min_by(entry, (d, entry)) AS entry FROM (
                SELECT p.*, b.entry, CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                FROM p JOIN b{0} b USING (part)) GROUP BY ALL),"""
    move = """
        u{0} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n
                 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{0}) GROUP BY ALL),
        m{0} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM u{0} GROUP BY ALL),
        b{1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{0} b LEFT JOIN m{0} m USING (part, entry)),"""
    for k in range(rounds):
        steps += near.format(k) + move.format(k, k + 1)
    steps += near.format(rounds)
    return steps + f"""
        h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
        c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""
