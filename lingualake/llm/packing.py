"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths, at most `capacity` numbers whatever the input, decides the packing:
a sequence starts with the longest length left and is filled greedily with the longest that fits; then
its smallest member gives way to two unpacked ones if together they fill its place more tightly. Each
such pattern is used as often as the counts allow. The plan maps ranks within a length to sequences, and
Spark ranks the pieces: rows of one length are dealt to many groups, numbered inside these, and
shifted by the sizes of the groups before, so a hot length doesn't meet in one task.

Cases: a null or empty text is the separator alone. Texts longer than the capacity are cut into full
pieces and a rest; full pieces are sequences of their own. Pieces of one length are interchangeable;
ties are ordered by id, piece and checksum. Repeated rows are packed each. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, held, staged, text_or_empty

CAPACITY = 2048
#: Rows of one length that one group numbers, about.
GROUP_ROWS = 4096
#: Texts whose unknown words are tokenised together.
BLOCK = 500
#: Parts of words that a worker remembers, twice.
MEMORY = 300_000
#: Texts of these characters are their own normal form but for case, so their parts can be looked up one by one.
_PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00ff]*")
_LETTERS = r"[a-z\u00df-\u00f6\u00f8-\u00ff]+"
_PARTS = re.compile(rf"{_LETTERS}|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_WORD = re.compile(_LETTERS)


class Words:
    """The ids of texts, as little-endian bytes, under the tokenizer file at `path`.

    No merge spans ASCII white space, nor the parts that the tokenizer cuts words into. Plain texts are
    cut the same way here and their parts looked up; words of other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Remembered(self._ids, MEMORY)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _PARTS.findall(text.lower())
        return [p for w in text.encode().split() for p in self._word(w.decode())]

    def _word(self, word: str) -> list[str]:
        return _PARTS.findall(word.lower()) if "<|" not in word and _PLAIN.fullmatch(word) else [word]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; unknown parts of letters are tokenised together."""
        split = [self._split(t) for t in texts]
        order = sorted(p for p in set().union(*split) - self.parts.keys() if _WORD.fullmatch(p))
        if order:
            found = self.tokenizer.encode(" ".join(order), add_special_tokens=False)
            ids, owner = np.asarray(found.ids, "<u4").tobytes(), np.asarray(found.word_ids)
            edges = (4 * np.searchsorted(owner, np.arange(len(order) + 1))).tolist()
            self.parts.update(zip(order, (ids[a:b] for a, b in zip(edges, edges[1:])), strict=True))
        known = self.parts.__getitem__
        for own in split:
            yield b"".join(map(known, own))


def _words(path: str) -> Words:
    return held(("packing", path), lambda: Words(path))


def _cut(path: str, capacity: int, separator: int):
    end = np.asarray([separator], "<u4").tobytes()
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            rows, piece, start, length, crc = (array("q") for _ in range(5))
            texts = batch.column("_text")
            for first in range(0, len(texts), BLOCK):
                for row, ids in enumerate(words.ids(texts[first : first + BLOCK].to_pylist()), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), size)):
                        part = ids[at : at + size]
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            numbers = [pa.array(np.frombuffer(x, np.int64)) for x in (start, length, crc)]
            owner = batch.column("_id").take(pa.array(np.frombuffer(rows, np.int64)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(np.frombuffer(piece, np.int64), pa.int32(), safe=False), *numbers], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the sequences that take `counts[length]` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[int, list[int]]] = []
    while left.any():
        pattern: list[int] = []
        gap, free = capacity, left.copy()
        while gap > 0 and len(fits := np.flatnonzero(free[: gap + 1])):
            pattern.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        if len(pattern) > 1 and gap > 0:
            pattern = _two_for_one(pattern, gap, free)
        used, need = np.unique(pattern, return_counts=True)
        times = int((left[used] // need).min())
        left[used] -= times * need
        patterns.append((times, pattern))
    return patterns


def _two_for_one(pattern: list[int], gap: int, free: np.ndarray) -> list[int]:
    """`pattern` with its smallest length replaced by the two free ones that fill its place best, if they fill more."""
    room = gap + pattern[-1]
    one = np.flatnonzero(free[:room])
    if not len(one):
        return pattern
    at = np.searchsorted(one, room - one, side="right") - 1
    at[(at >= 0) & (one[at] == one) & (free[one] < 2)] -= 1
    total = np.where(at >= 0, one + one[at], 0)
    best = int(total.argmax())
    return [*pattern[:-1], int(one[best]), int(one[at[best]])] if total[best] > pattern[-1] else pattern


def _places(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length * 2**40 + first rank, with the first sequence and the offset of each run of ranks."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            rows.append(((length << 40) + rank, sequence, offset))
            ranks[length] = rank + times
            offset += length
        sequence += times
    keys, sequences, offsets = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return keys, sequences, offsets


def _place(places: tuple[np.ndarray, np.ndarray, np.ndarray]):
    keys, sequences, offsets = places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("length").to_numpy() << 40) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            rest = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], [*rest, "sequence_id", "offset"])

    return run


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) of each text's ids followed by `separator`."""
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(_cut(path, capacity, separator), "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`found` (id, piece, start, length, ids_crc32; as a written table) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    groups = min(1 << 20, max(16, -(-max(counts.values(), default=0) // GROUP_ROWS)))
    dealt = found.withColumn("_group", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_group", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_group").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_inside", inside).join(sizes, ["length", "_group"]).withColumn("rank", F.col("_before") + F.col("_inside"))
    columns = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint").alias("rank"))
    return rows.mapInArrow(_place(_places(plan(counts, capacity))), f"{columns}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """The pieces of `df`'s texts in sequences of at most `capacity` ids; tokenises once and writes the pieces' table."""
    return pack(staged(pieces(df, path, id_col, text_col, capacity, separator)), capacity).withColumnRenamed("id", id_col)
