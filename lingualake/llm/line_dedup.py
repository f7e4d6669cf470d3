"""Line deduplication with two Bloom filters: one for hashes seen once, one for hashes seen twice.

Each task reduces its lines to sorted bit positions of the keys it saw in one document and in several.
Merged slot by slot in two rounds, row after row, a bit that two tasks have seen joins the twice-seen filter. Only lines whose key
is in that filter are shuffled, as 128-bit digests; grouping these decides exactly which keys repeat
and which document keeps them. Documents that lose a line (found through a bitmap of bounded size) are
joined with their list; all others pass without a shuffle.

Cases: a null text counts as empty and is one empty line. Keys are compared by digest, so repeated
lines inside one document count that document once. Repeated rows of one id count as one document.
Rows without an id neither count nor lose lines. Ties can't arise, as the largest id keeps a key. An
empty table gives an empty result. Other columns come along unchanged where `carry` names them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, key_bitmap, salted_left_join, staged, text_or_empty, with_flag

#: Bits of a filter: 16 MiB each whatever the input. When they fill up, more lines are confirmed by the shuffle, none is lost.
FILTER_BITS = 27
SLOT_BITS = 20
#: Parts in which a slot's rows are merged before the slot is.
SALTS = 8
FLUSH = 1_000_000
DOC_BITS = 25


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, ASCII-lower-cased line, or None if it has under `min_chars` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    keys = (line_key(line, min_chars) for line in text.split(b"\n"))
    return {xxhash.xxh3_128_digest(key) for key in keys if key is not None}


def _positions(digests: np.ndarray) -> np.ndarray:
    """Both bit positions of each 16-byte digest, one row each."""
    return (digests.view("<u8").reshape(-1, 2) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.uint32)


def _slots(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """Rows (slot, task, once, twice) of the sorted distinct positions inside each slot."""
    rows, task = [], TaskContext.get().partitionId()
    edges = np.arange((1 << (FILTER_BITS - SLOT_BITS)) + 1, dtype=np.uint64) << np.uint64(SLOT_BITS)
    a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    for slot in np.flatnonzero(a[1:] > a[:-1]):
        rows.append((int(slot), task, once[a[slot] : a[slot + 1]].tobytes(), twice[b[slot] : b[slot + 1]].tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:])], ["slot", "task", "once", "twice"])


def _seen(min_chars: int):
    def flush(found: list[bytes]) -> pa.RecordBatch:
        distinct, counts = np.unique(np.frombuffer(b"".join(found), dtype="V16"), return_counts=True)
        return _slots(np.unique(_positions(distinct)), np.unique(_positions(distinct[counts > 1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                found += _digests(text, min_chars)
                if len(found) >= FLUSH:
                    yield flush(found)
                    found = []
        if found:
            yield flush(found)

    return run


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), bitorder="little").astype(bool)


def _merge(packed: bool):
    """Rows (slot, once, twice) of packed bits, one for each slot of rows sorted by slot, which are read one at a time.

    These hold positions, or packed bits of a merge before.
    """
    size = 1 << SLOT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, again = None, np.zeros(size, bool), np.zeros(size, bool)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([_packed(seen)], pa.binary()), pa.array([_packed(again)], pa.binary())], ["slot", "once", "twice"])
        for batch in batches:
            for slot, once, twice in zip(*(batch.column(n) for n in ("slot", "once", "twice")), strict=True):
                if slot.as_py() != current:
                    if current is not None:
                        yield row()
                    current, seen, again = slot.as_py(), np.zeros(size, bool), np.zeros(size, bool)
                if packed:
                    own = _unpacked(once.as_py())
                    again |= _unpacked(twice.as_py()) | (seen & own)
                    seen |= own
                else:
                    at = np.frombuffer(once.as_py(), np.uint32) & np.uint32(size - 1)
                    again[at[seen[at]]] = True
                    seen[at] = True
                    again[np.frombuffer(twice.as_py(), np.uint32) & np.uint32(size - 1)] = True
        if current is not None:
            yield row()

    return run


def _merged(seen: DataFrame) -> DataFrame:
    """Rows (slot, once, twice) of packed bits, one for each slot: first the tasks' rows in SALTS parts of a slot, then these."""
    kind = "slot int, once binary, twice binary"
    parts = seen.withColumn("salt", F.pmod(F.xxhash64("task"), F.lit(SALTS))).repartition("slot", "salt").sortWithinPartitions("slot", "salt")
    first = parts.select("slot", "once", "twice").mapInArrow(_merge(False), kind)
    return first.repartition("slot").sortWithinPartitions("slot").mapInArrow(_merge(True), kind)


def _filter(shared) -> np.ndarray:
    """The twice-seen filter as bytes, unpacked once in each worker."""

    def unpacked() -> np.ndarray:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for slot, packed in shared.value.items():
            start = slot << (SLOT_BITS - 3)
            bits[start : start + (1 << (SLOT_BITS - 3))] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return bits

    return held(("lines", shared.id), unpacked)


class _Shared:
    """A broadcast variable with a number by which workers know it."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _suspects(shared: _Shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _filter(shared)
        for batch in batches:
            digests, owners = [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                own = sorted(_digests(text, min_chars))
                digests += own
                owners += [row] * len(own)
            at = _positions(np.frombuffer(b"".join(digests), dtype="V16"))
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1) if len(at) else np.zeros(0, bool)
            rows = np.flatnonzero(hit)
            ids = batch.column("_id").take(pa.array(np.asarray(owners, np.int64)[rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([digests[i] for i in rows], pa.binary())], ["_id", "key"])

    return run


def _apply(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, lost = [], [], []
            for text, drops in zip(batch.column("_text").to_pylist(), batch.column("_drops").to_pylist(), strict=True):
                lines = text.split(b"\n")
                total.append(len(lines))
                if drops:
                    gone = set(drops)
                    lines = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                    text = b"\n".join(lines)
                kept.append(text.decode("utf-8", "replace"))
                lost.append(total[-1] - len(lines))
            rest = [n for n in batch.schema.names if n not in ("_text", "_drops")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*rest, "kept_text", "n_lines", "n_dropped"])

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (id, *carry, kept_text, n_lines, n_dropped): `df` without the lines that repeat across documents.

    A key of `min_chars` code points or more found in `min_docs` documents or more loses its lines
    everywhere but in the document with the largest id.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).cast("binary").alias("_text"), *(F.col(c).alias(f"_carry_{c}") for c in carry))
    known = rows.filter("_id is not null").select("_id", "_text")
    seen = known.select("_text").mapInArrow(_seen(min_chars), "slot int, task int, once binary, twice binary")
    merged = _merged(seen).select("slot", "twice").collect()  # at most 2**(FILTER_BITS - SLOT_BITS) rows
    shared = _Shared(spark, {r["slot"]: bytes(r["twice"]) for r in merged})
    suspects = staged(known.mapInArrow(_suspects(shared, min_chars), "_id bigint, key binary"))
    repeated = suspects.groupBy("key").agg(F.count_distinct("_id").alias("docs"), F.max("_id").alias("keeper")).filter(F.col("docs") >= min_docs)
    lost = salted_left_join(suspects.distinct(), repeated, "key", "_id").filter("_id <> keeper")
    drops = staged(lost.groupBy("_id").agg(F.collect_list("key").alias("_drops")))
    flagged = with_flag(rows, key_bitmap(drops, F.col("_id"), DOC_BITS), F.col("_id"), DOC_BITS, "_loses")
    out = T.StructType([T.StructField("_id", T.LongType()), *(T.StructField(f"_carry_{c}", df.schema[c].dataType) for c in carry), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    whole = flagged.filter("not _loses").drop("_loses").withColumn("_drops", F.lit(None).cast("array<binary>"))
    cut = flagged.filter("_loses").drop("_loses").join(drops, "_id", "left")
    done = whole.unionByName(cut).mapInArrow(_apply(min_chars), out)
    return done.select(F.col("_id").alias(id_col), *(F.col(f"_carry_{c}").alias(c) for c in carry), "kept_text", "n_lines", "n_dropped")
