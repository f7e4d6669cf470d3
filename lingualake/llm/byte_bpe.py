"""Byte-level BPE encoding and decoding by replaying merges over a whole list of words.

The corpus is cut into chunks: white space and the run of other characters behind it, a cut that no match
of the tokenizer's pattern crosses. Distinct chunks are counted over the whole corpus. Those that make up at
least one in FREQUENT of it are a table of bounded size; it is encoded once, as rows that Spark deals out,
and sent to the tasks that encode the documents. Chunks that it lacks are encoded in their task, those of a
block of documents together.

Both ways replay the merges over all words at once. Words of up to SHORT bytes lie in a matrix for each length: a step
makes the first merge of lowest rank in every row, which is then one token shorter, and looks up the pairs of its two
neighbours only. Rows that nothing merges leave. For longer words an index from each merged token to the places of
the pairs that make it is emptied in order of rank. A merge that makes a pair of lower or equal rank gives way to it,
so that every word sees its merges in the order in which it would see them alone.

Cases: a null or empty text has no ids and decodes to an empty text. A match that is a token as a whole is that
token. A chunk over LONGEST characters is encoded where it stands and not remembered. Unknown ids raise when
decoded; bytes that are no UTF-8 become U+FFFD in a decoded text, not in its digest. Ties of rank go to the left.
Letters and numbers are those of the regex package, whose Unicode tables may be newer than another library's.
Repeated rows give equal results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, staged, text_or_empty

#: A chunk is sent to all tasks if it is at least one in FREQUENT of all chunks, so at most FREQUENT are.
FREQUENT = 100_000
#: Longer chunks, in characters, are in no table.
LONGEST = 64
#: Longer words, in bytes, are merged by the index of places.
SHORT = 32
#: Chunks, and words, that a worker remembers; distinct chunks that a task counts before it hands them on.
MEMORY = 300_000
#: Texts whose unknown chunks are encoded together.
BLOCK = 500
#: The characters with the property White_Space, which differ from what this language's \s matches.
_SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: Texts without these, and without white space but blanks and line feeds, are cut by splitting at blanks.
_UNEVEN = ("  ", " \n", "\n ", "\n\n\n", "\0", *sorted(set(_SPACES) - set(" \n")))


def _named(chunk: str) -> str:
    if chunk[0] not in _SPACES:
        return f"\0{chunk}"
    return chunk[1:] if chunk[0] == " " and chunk[1:2] not in ("", "\0", *_SPACES) else chunk


def cut(text: str) -> list[str]:
    """The chunks of a text by their names; the pattern's matches in each are its matches in the text.

    The name of a chunk that is a blank and a word leaves the blank out; that of one without white space, which only
    begins a text, has U+0000 in front.
    """
    if any(x in text for x in _UNEVEN) or text.endswith((" ", "\n\n")):
        return [_named(c) for c in _CHUNKS.findall(text)]
    if not text:
        return []
    first, *rest = text.replace("\n", " \n").split(" ")
    return [f"\0{first}", *rest] if first else rest


def chunk_text(name: str) -> str:
    """The chunk of a name."""
    return name[1:] if name[0] == "\0" else name if name[0] in _SPACES else f" {name}"


#: Above every rank, and above every pair of ranks.
_NEVER, _NO_PAIR = 2**31 - 1, 2**63 - 1


class _Unions(dict):
    """The token that a pair of tokens merges to, or -1, by left << 32 | right."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        if len(self) >= 4 * MEMORY:
            self.clear()
        found = self[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return found


class Ranks:
    """The vocabulary of a rank file, with the pattern that cuts texts into matches."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.unions = _Unions(self.ranks, self.tokens)
        self.matches = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that merge, as left << 32 | right in ascending order, and what each merges to; the last is none."""
        ranks = self.ranks
        halves = ((token[:k], token[k:], rank) for token, rank in ranks.items() for k in range(1, len(token)))
        found = sorted((ranks[x] << 32 | ranks[y], rank) for x, y, rank in halves if x in ranks and y in ranks)
        keys, made = zip(*found, (_NO_PAIR, _NEVER), strict=True)
        return np.array(keys, np.int64), np.array(made, np.int32)

    @cached_property
    def byte_pairs(self) -> np.ndarray:
        """What each pair of bytes merges to."""
        at = np.array(self.bytes, np.int32)
        return self._made(np.repeat(at, 256), np.tile(at, 256))

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, made = self.pairs
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, made[at], np.int32(_NEVER))

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all merges applied to all words in order of rank."""
        lengths: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            lengths.setdefault(len(word) if len(word) <= SHORT else 0, []).append(k)
        found: list[list[int]] = [[]] * len(words)
        for length, places in lengths.items():
            own = [words[k] for k in places]
            for k, ids in self._replay_short(own, length) if length else enumerate(self._replay_long(own)):
                found[places[k]] = ids
        return found

    def _replay_short(self, words: list[bytes], length: int) -> Iterator[tuple[int, list[int]]]:
        """(place, ids) of each word, all of `length` bytes."""
        data = np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)
        at = np.array(self.bytes, np.int32)[data]
        made = self.byte_pairs[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]]
        places = np.arange(len(words))
        while at.shape[1] > 1:
            first = made.argmin(axis=1)
            rank = made[np.arange(len(at)), first]
            merges = rank < _NEVER
            if not merges.all():
                yield from zip(places[~merges].tolist(), at[~merges].tolist(), strict=True)
                at, made, places, first, rank = at[merges], made[merges], places[merges], first[merges], rank[merges]
            rows, width = np.arange(len(at)), at.shape[1]
            keep = np.arange(width) != first[:, None] + 1
            at[rows, first] = rank
            at = at[keep].reshape(len(rows), width - 1)
            made = made[keep[:, 1:]].reshape(len(rows), width - 2)
            if width > 2:
                left, right = first > 0, first < width - 2
                made[rows[left], first[left] - 1] = self._made(at[left, first[left] - 1], rank[left])
                made[rows[right], first[right]] = self._made(rank[right], at[right, first[right] + 1])
        yield from zip(places.tolist(), at.tolist(), strict=True)

    def _replay_long(self, words: list[bytes]) -> list[list[int]]:
        at: list[int] = []
        starts = []
        for word in words:
            starts.append(len(at))
            at.extend(map(self.bytes.__getitem__, word))
            at.append(-1)
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        unions = self.unions
        places: dict[int, list[int]] = {}
        for p in range(len(at) - 1):
            if at[p] >= 0 and at[p + 1] >= 0 and (made := unions[at[p] << 32 | at[p + 1]]) >= 0:
                places.setdefault(made, []).append(p)
        order = list(places)
        heapify(order)
        while order:
            rank = heappop(order)
            open_places = sorted(places.pop(rank, ()))
            for k, p in enumerate(open_places):
                q = after[p]
                if at[p] < 0 or at[q] < 0 or unions[at[p] << 32 | at[q]] != rank:
                    continue
                at[p], at[q] = rank, -1
                right, left = after[q], before[p]
                after[p], before[right] = right, p
                first = rank + 1
                for x, y in ((p, right), (left, p)):
                    if x >= 0 and at[x] >= 0 and at[y] >= 0 and (made := unions[at[x] << 32 | at[y]]) >= 0:
                        if made not in places:
                            places[made] = []
                            heappush(order, made)
                        places[made].append(x)
                        first = min(first, made)
                if first <= rank:
                    if rank not in places:
                        places[rank] = []
                        heappush(order, rank)
                    places[rank] += open_places[k + 1 :]
                    break
        found = []
        for p in starts:
            ids = []
            while at[p] >= 0:
                ids.append(at[p])
                p = after[p]
            found.append(ids)
        return found

    def encode_all(self, chunks: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each chunk by its name; the words of all that aren't remembered are merged together."""
        if len(self.words) > MEMORY:
            self.words = {}
        find, known, ranks = self.matches, self.words, self.ranks
        words = {c: find(chunk_text(c)) for c in chunks}
        merged: dict[str, bytes] = {}
        for w in {w for own in words.values() for w in own if w not in known}:
            data = w.encode()
            if (rank := ranks.get(data)) is None:
                merged[w] = data
            else:
                known[w] = [rank]
        known.update(zip(merged, self.replay(list(merged.values())), strict=True))
        found = {c: known[own[0]] if len(own) == 1 else [i for w in own for i in known[w]] for c, own in words.items()}
        for w, data in merged.items():
            if len(data) > LONGEST:
                del known[w]
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Chunks:
    """The encoded chunks that a worker knows: the frequent ones, and others while there is room."""

    def __init__(self, path: str, pattern: str, frequent: dict[str, str]):
        self.ranks = Ranks(path, pattern)
        self.names = {i: str(i) for i in self.ranks.tokens}
        self.frequent = self._formed({c: list(map(int, ids.split(","))) for c, ids in frequent.items()})
        self.known = self.frequent.copy()

    def _formed(self, ids: dict[str, list[int]]) -> dict[str, tuple[str, bytes]]:
        names, tokens = self.names, self.ranks.tokens
        return {c: (",".join([names[i] for i in own]), b"".join([tokens[i] for i in own])) for c, own in ids.items()}

    def forms(self, texts: list[str]) -> Iterator[list[tuple[str, bytes]]]:
        """Each text as the ids and the decoded bytes of its chunks."""
        chunks = [cut(t) for t in texts]
        unknown = set().union(*chunks).difference(self.known)
        self.known |= self._formed(self.ranks.encode_all(unknown))
        for own in chunks:
            yield list(map(self.known.__getitem__, own))
        if len(self.known) > FREQUENT + MEMORY:
            self.known = self.frequent.copy()
        else:
            for c in unknown:
                if len(c) > LONGEST:
                    del self.known[c]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        kept = [c for c in found if len(c) <= LONGEST]
        batch = pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([found[c] for c in kept], pa.int64())], ["chunk", "n"])
        found.clear()
        return batch

    for batch in batches:
        for text in batch.column("_text").to_pylist():
            found.update(cut(text))
            if len(found) >= MEMORY:
                yield rows()
    yield rows()


def chunk_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (chunk, n): how often each chunk of at most LONGEST characters occurs."""
    return df.select(text_or_empty(text_col).alias("_text")).mapInArrow(_counted, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))


def _replayed(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held(("ranks", path, pattern), lambda: Ranks(path, pattern))
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            ids = ranks.encode_all(chunks)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array([ids[c] for c in chunks], pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    return run


def encoded_chunks(counts: DataFrame, path: str, pattern: str) -> DataFrame:
    """`counts` (chunk, n) with the ids of each chunk: merges are replayed over the chunks of a batch together."""
    return counts.mapInArrow(_replayed(path, pattern), "chunk string, n bigint, ids array<int>")


def frequent_chunks(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> dict[str, str]:
    """The ids, joined by commas, of the chunks that are at least one in FREQUENT of the corpus; at most FREQUENT."""
    counts = staged(chunk_counts(df, text_col))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = encoded_chunks(counts.filter(F.col("n") * FREQUENT >= total), path, pattern)
    found = rows.select("chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")).toArrow()
    return dict(zip(found.column("chunk").to_pylist(), found.column("ids").to_pylist(), strict=True))


def _encoder(df: DataFrame, path: str, pattern: str, text_col: str):
    """What gives the forms of a block of texts in a task, with the frequent chunks sent along."""
    sent = df.sparkSession.sparkContext.broadcast(frequent_chunks(df, path, pattern, text_col))
    key = ("byte_bpe", path, pattern, uuid.uuid4().hex)

    def forms(batch: pa.RecordBatch) -> Iterator[list[tuple[str, bytes]]]:
        chunks = held(key, lambda: _Chunks(path, pattern, sent.value))
        texts = batch.column("_text")
        for first in range(0, len(texts), BLOCK):
            yield from chunks.forms(texts[first : first + BLOCK].to_pylist())

    return forms


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), f"id {df.schema[id_col].dataType.simpleString()}"


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the ids of each text under the rank file at `path`, each match of `pattern` merged by itself."""
    forms = _encoder(df, path, pattern, text_col)
    rows, kind = _rows(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[int(i) for x, _ in found for i in x.split(",")] for found in forms(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(run, f"{kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held(("ranks", path, pattern), lambda: Ranks(path, pattern))
        for batch in batches:
            texts = [ranks.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, text string")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) without storing ids or decoded bytes."""
    forms = _encoder(df, path, pattern, text_col)
    rows, kind = _rows(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, texts = [], [], []
            for found in forms(batch):
                joined = ",".join([x for x, _ in found])
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join([x for _, x in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"{kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
