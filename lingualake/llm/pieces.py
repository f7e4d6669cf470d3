"""SentencePiece (merge type) encoding and decoding with a prefix table.

Under merge-type tokenisation every prefix of a text has one last piece, and two pieces may follow each
other exactly if merging the characters of both leaves the two. So an automaton over the vocabulary
reports the pieces ending at each place, the first one that fits the last piece of the prefix before it
is stored, and the ids are read backwards from the end. Fits are tested once for each pair by merging
and remembered.

No piece spans a word start or, in most models, goes from letters to other characters; the vocabulary
tells. Texts are cut there, and the ids of a segment are kept in a table of bounded size. Rows never
leave their task.

Cases: a null or empty text has no ids and decodes to an empty text. Characters outside the vocabulary
become byte pieces. A text's own U+2581 is read as a space, as the library does. Very long segments
cost time in proportion to their length. Repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, held, text_or_empty

SPACE = "▁"
#: Segments and pairs that a worker remembers.
MEMORY = 300_000
_LETTERS = "A-Za-z\u00c0-\u024f"
#: The finest cuts first; the first that no piece spans serves.
_CUTS = [re.compile(f" *[{_LETTERS}]+| *[^ \n{_LETTERS}]+| +|\n"), re.compile(" *[^ \n]+| +|\n"), re.compile(" *[^ ]+| +"), re.compile("(?s).+")]


class PieceTable:
    """The vocabulary of a merge-type model file, with the tests that encoding needs."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in normal}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: model.get_score(i) for t, i in self.id.items()}
        self.known = {t for t in self.id if len(t) == 1}
        if not all(self.known.issuperset(t) for t in self.id):
            raise ValueError("a piece has characters that are no pieces")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.cut = next(c for c in _CUTS if all(c.fullmatch(t.replace(SPACE, " ")) for t in self.id))
        self.whole = {i for t, i in self.id.items() if self.merge(t) == [i]}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if i in self.whole:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[int]:
        """The ids of `text` by the definition: merge the pair whose union scores best, the leftmost of equals, until none is left."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= 4 * MEMORY:
                self.fits.clear()
            found = self.fits[left, right] = self.merge(self.text[left] + self.text[right]) == [left, right]
        return found

    def _known_ids(self, text: str) -> list[int]:
        """The ids of a text of known characters."""
        last: list[int | None] = [None] * (len(text) + 1)
        fits, fit = self.fits, self.fit
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - size]
                if end == size or (before is not None and ((known := fits.get((before, piece))) or (known is None and fit(before, piece)))):
                    last[end] = piece
        ids = []
        end = len(text)
        while end:
            ids.append(last[end])
            end -= len(self.text[last[end]])
        return ids[::-1]

    def segment_ids(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self._known_ids(text)
        ids: list[int] = []
        run = ""
        for c in text:
            if c in self.known:
                run += c
                continue
            ids += self._known_ids(run) if run else []
            run = ""
            ids += [self.bytes[b] for b in c.encode("utf-8")]
        return ids + (self._known_ids(run) if run else [])

    def segment_text(self, ids: list[int]) -> str:
        """The text of ids, U+2581 as spaces."""
        out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in ids)
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s.replace(" ", SPACE))]

    def decode(self, ids: list[int]) -> str:
        text = self.segment_text(ids)
        return text[1:] if text.startswith(" ") else text

    def segments(self, text: str) -> list[str]:
        """The parts of a text, with the space put before it, that no piece spans."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def both(self, segment: str) -> tuple[str, str]:
        """A segment's ids joined by commas, and the text that these ids decode to."""
        ids = self.segment_ids(segment.replace(" ", SPACE))
        text = self.segment_text(ids)
        return ",".join(map(str, ids)), segment if text == segment else text


def _loaded(path: str) -> tuple[PieceTable, Remembered]:
    """The table of a model and its segments, once in each worker."""

    def load() -> tuple[PieceTable, Remembered]:
        table = PieceTable(path)
        return table, Remembered(table.both, MEMORY)

    return held(("pieces", path), load)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, segments = _loaded(path)
        known = segments.__getitem__
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column("_text").to_pylist():
                found = list(map(known, table.segments(text)))
                joined = ",".join([x for x, _ in found])
                decoded = "".join([x for _, x in found])
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.removeprefix(" ").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _loaded(path)
        for batch in batches:
            texts = [table.decode(ids or []) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], ["id", "text"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, segments = _loaded(path)
        known = segments.__getitem__
        for batch in batches:
            ids = [[int(i) for x, _ in map(known, table.segments(text)) for i in x.split(",")] for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the ids of each text under the model file at `path`."""
    return df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(_ids(path), f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the text of each row's ids."""
    return df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(_decode(path), f"id {df.schema[id_col].dataType.simpleString()}, text string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) without storing ids or decoded texts."""
    kind = f"id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(_encode(path), kind)
