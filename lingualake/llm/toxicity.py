"""A toxicity classifier: a subsequence-kernel support vector machine on sentences, with Nyström landmarks.

The gap-weighted subsequence kernel compares a word with a landmark by their shared subsequences of
three characters, each weighing less the more it is stretched, so insults with inserted characters stay
close. A word that holds a landmark's letters in order, at most GAP others between two of them, is read
without these too: two and more inserted characters leave little of a kernel that both words normalise.
A sentence's similarity to a landmark is that of its closest word window. Landmarks are words and
word beginnings that a bounded sample of labelled rows ties to toxic texts beyond chance, near copies of
a text counted once. The sample's
sentences train a linear machine in the space that the landmarks span (Nyström), which folds into one
weight for each landmark; a document scores as its worst sentence, mapped to a likelihood.

Windows that share too few character pairs with a landmark, gapped ones counted, are not compared with
it: their similarity counts as none. Each worker remembers a bounded number of words.

Cases: a null or empty text has no words and scores as a text without any hit. Labels other than 0 and 1
or without a document are left out; of repeated labels the greater counts. Without both labels, or with
no telling word, every score is the share of toxic labels, at most 0.5. Words of any length are read
whole, window by window. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, text_or_empty

#: At most so many labelled rows of each kind are learned from, those with the smallest hashed ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 5_000, 15_000
LANDMARKS = 64
ORDER, DECAY = 3, 0.7
WINDOW = 8
NEAR = 0.45
#: Inserted characters that may stand between two letters of a landmark.
GAP = 2
MEMORY = 200_000
#: Texts that a worker scores at a time.
ROWS = 500
_PUNCTUATION = ".,;:!?\"'()[]{}#$%&*|-"
_EDGE = re.compile(r"^\W+|\W+$")
_INSIDE = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w){3,}(?!\w)")
_LEET = str.maketrans("013457@$", "oleastas")


def kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each row of `left` with that row of `right` (code points, 0 beyond the end)."""
    n, m = left.shape[1], right.shape[1]
    same = ((left[:, :, None] == right[:, None, :]) & (left[:, :, None] > 0)).astype(np.float32)
    prefix = np.ones((len(left), n + 1, m + 1), np.float32)
    for _ in range(order - 1):
        step = decay**2 * same * prefix[:, :n, :m]
        longer = np.zeros_like(prefix)
        for i in range(n):
            ending = np.zeros(len(left), np.float32)
            for j in range(m):
                ending = decay * ending + step[:, i, j]
                longer[:, i + 1, j + 1] = decay * longer[:, i, j + 1] + ending
        prefix = longer
    return decay**2 * (same * prefix[:, :n, :m]).sum((1, 2))


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words, f"<U{WINDOW}").view(np.uint32).reshape(len(words), -1)


def _likeness(left: np.ndarray, right: np.ndarray, left_self: np.ndarray, right_self: np.ndarray) -> np.ndarray:
    """The normalised kernel of row pairs, in blocks that bound the memory."""
    blocks = [kernel(left[i : i + 20_000], right[i : i + 20_000]) for i in range(0, len(left), 20_000)]
    return np.concatenate([*blocks, np.zeros(0)]) / np.sqrt(np.maximum(left_self * right_self, 1e-12))


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each word of at most WINDOW characters with each landmark."""
    a, b = _codes(words), _codes(landmarks)
    i, j = np.repeat(np.arange(len(words)), len(landmarks)), np.tile(np.arange(len(landmarks)), len(words))
    return _likeness(a[i], b[j], kernel(a, a)[i], kernel(b, b)[j]).reshape(len(words), -1)


def _pair_bits(codes: np.ndarray, gaps: int) -> np.ndarray:
    """A 64-bit set for each row: a hashed bit for each pair of characters at most `gaps` places apart."""
    wide = codes.astype(np.uint64)
    bits = np.zeros(len(codes), np.uint64)
    for gap in range(1, gaps + 1):
        if codes.shape[1] > gap:
            a, b = wide[:, :-gap], wide[:, gap:]
            at = ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(58)) & np.uint64(63)
            found = np.where((a > 0) & (b > 0), np.uint64(1) << at, np.uint64(0))
            bits |= np.bitwise_or.reduce(found, axis=1)
    return bits


def windows(token: str) -> list[str]:
    """The strings that stand for a token: its letters, read through inserted and look-alike characters, in windows of WINDOW."""
    forms = [token]
    if not token.isalpha():
        bare = _EDGE.sub("", token)
        forms = [bare] if bare.isalpha() else [bare, _INSIDE.sub("", bare), _INSIDE.sub("", bare.translate(_LEET))]
    out: list[str] = []
    for form in dict.fromkeys(forms):
        if len(form) >= ORDER:
            out += [form[i : i + WINDOW] for i in range(0, max(1, len(form) - ORDER), WINDOW // 2)]
    return out


def tokens(text: str) -> list[str]:
    return text.split() + [m.group().replace(" ", "") for m in _SPACED.finditer(text)]


def _gapped(landmarks: list[str]) -> dict[str, list[tuple[str, re.Pattern]]]:
    """By first letter, landmarks and what matches them with inserted characters; of long ones a word may be a longer form."""
    out: dict[str, list[tuple[str, re.Pattern]]] = {}
    for mark in landmarks:
        between = f".{{0,{GAP}}}".join(map(re.escape, mark))
        tail = ".*" if len(mark) > 5 else f"{re.escape(mark[-1])}*"
        out.setdefault(mark[0], []).append((mark, re.compile(f"({between}){tail}")))
    return out


class _Hits:
    """Of tokens, the landmarks that a window of theirs is near to, with the similarity."""

    def __init__(self, landmarks: list[str]):
        self.gapped = _gapped(landmarks)
        self.codes = _codes(landmarks)
        self.bits = _pair_bits(self.codes, 1)
        self.need = np.ceil(0.7 * np.bitwise_count(self.bits)).astype(np.uint8)
        self.selves = kernel(self.codes, self.codes)
        self.known: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _read_through(self, token: str) -> list[str]:
        """The landmarks that a token is with two or more characters inserted; one leaves it near enough by itself."""
        found = ((mark, pattern.fullmatch(token)) for mark, pattern in self.gapped.get(token[:1], ()) if len(token) > len(mark) + 1)
        return [mark for mark, m in found if m and len(m.group(1)) > len(mark) + 1]

    def learn(self, tokens: set[str]) -> None:
        """Remembers for each token its hits as (landmark, similarity) pairs, or None. Tokens not asked for lately go."""
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        new = tokens - self.known.keys()
        again = new & self.old.keys()
        self.known.update((t, self.old[t]) for t in again)
        forms: dict[str, list[str]] = {}
        for token in sorted(new - again):
            forms.setdefault(token.strip(_PUNCTUATION), []).append(token)
        self.known.update(dict.fromkeys(new - again))
        owners, parts, bare = [], [], list(forms)
        for k, token in enumerate(bare):
            for w in windows(token) + self._read_through(token):
                owners.append(k)
                parts.append(w)
        if not parts:
            return
        codes = _codes(parts)
        bits = _pair_bits(codes, 3)
        near = [np.flatnonzero(np.bitwise_count(bits & own) >= need) for own, need in zip(self.bits, self.need, strict=True)]
        rows, marks = np.concatenate(near), np.repeat(np.arange(len(near)), [len(x) for x in near])
        parts_at, back = np.unique(rows, return_inverse=True)
        selves = np.concatenate([kernel(codes[parts_at[i : i + 20_000]], codes[parts_at[i : i + 20_000]]) for i in range(0, len(parts_at), 20_000)] + [np.zeros(0)])
        values = _likeness(codes[rows], self.codes[marks], selves[back], self.selves[marks])
        best: dict[int, dict[int, float]] = {}
        for k in np.flatnonzero(values >= NEAR).tolist():
            found = best.setdefault(owners[rows[k]], {})
            found[int(marks[k])] = max(found.get(int(marks[k]), 0.0), float(values[k]))
        for k, found in best.items():
            self.known.update(dict.fromkeys(forms[bare[k]], tuple(found.items())))

    def of(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """For each text, the similarities of its sentences that have a hit."""
        for start in range(0, len(texts), ROWS):
            split = [tokens(t) for t in texts[start : start + ROWS]]
            distinct = [set(t) for t in split]
            self.learn(set().union(*distinct))
            for words, own in zip(split, distinct, strict=True):
                yield self._sentences(words) if any(map(self.known.get, own)) else []

    def _sentences(self, words: list[str]) -> list[np.ndarray]:
        out, row = [], None
        for word in words:
            for j, value in self.known[word] or ():
                row = np.zeros(len(self.bits), np.float32) if row is None else row
                row[j] = max(row[j], value)
            if row is not None and word[-1] in ".!?":
                out.append(row)
                row = None
        return out if row is None else [*out, row]


@dataclass(frozen=True)
class Model:
    """Landmarks, a weight for each and a bias; `slope` and `shift` map a margin to a likelihood."""

    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float

    def likelihood(self, margin: float) -> float:
        side = max(-1.0, min(1.0, margin))  # beyond the margins a text is no likelier toxic, only ranked further
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * side + self.shift + 0.05 * (margin - side)))))


def _hits(landmarks: tuple[str, ...]) -> _Hits:
    return held(("toxicity", landmarks), lambda: _Hits(list(landmarks)))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t.lower() for t in batch.column("_text").to_pylist()]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, toxic, clean): in how many of a batch's documents a word or word beginning occurs."""
    for batch in batches:
        counts: list[Counter] = [Counter(), Counter()]
        for text, label in zip(_texts(batch), batch.column("label").to_pylist(), strict=True):
            words = {w for t in set(tokens(text)) if len(w := _INSIDE.sub("", t)) >= ORDER}
            counts[label].update({w[:n] for w in words for n in (4, 5, 6) if len(w) >= n} | {w for w in words if len(w) <= WINDOW})
        terms = list(counts[0].keys() | counts[1].keys())
        toxic, clean = ([counts[k][t] for t in terms] for k in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["term", "toxic", "clean"])


def _training_rows(landmarks: tuple[str, ...]):
    """Rows (_id, label, near): the three closest sentences of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, near = [], []
            for k, found in enumerate(_hits(landmarks).of(_texts(batch))):
                for row in sorted(found, key=lambda x: -x.max())[:3]:
                    at.append(k)
                    near.append(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(at, pa.int64())) for n in ("_id", "label")), pa.array(near, pa.list_(pa.float32()))], ["_id", "label", "near"])

    return run


def _scores(model: Model):
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = [t.lower() for t in part.column(0).to_pylist()]
            margins = [model.bias + max([0.0, *(float(weights @ r) for r in rows)]) for rows in _hits(model.landmarks).of(texts)] if model.landmarks else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([model.likelihood(m) for m in margins], pa.float64())], [*part.schema.names[1:], "score"])

    return run


def _telling(terms: DataFrame, toxic: int, clean: int) -> list[str]:
    """Landmarks: the terms that occur in toxic documents beyond chance, none close to one before it."""
    share = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    rate = F.col("toxic") / n
    bound = F.col("toxic") * F.log(rate / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 3")
    best = counts.filter(F.col("toxic") / (n + 2) >= 0.75).select("term", bound.alias("bound")).filter("bound > 14")
    found = best.orderBy(F.desc("bound"), F.desc(F.length("term")), "term").limit(16 * LANDMARKS).collect()
    chosen: list[str] = []
    for row in found:
        if len(chosen) < LANDMARKS and (not chosen or similarities([row["term"]], chosen).max() < 0.6):
            chosen.append(row["term"])
    return chosen


def _machine(near: np.ndarray, label: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over landmark similarities and a bias: squared hinge loss in the Nyström space."""
    values, vectors = np.linalg.eigh(basis)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    x = np.hstack([near @ root, np.ones((len(near), 1))])
    y = np.where(label > 0, 1.0, -1.0)
    c = np.full(len(y), 1 / len(y))
    w = v = np.zeros(x.shape[1])
    step = 1 / (2 * float(np.linalg.eigvalsh((x * c[:, None]).T @ x)[-1]) + 1e-4)
    for k in range(1, 600):
        slack = np.maximum(0, 1 - y * (x @ v))
        after = v - step * (-2 * (x * (c * y * slack)[:, None]).sum(0) + 1e-4 * v)
        v = after + (k - 1) / (k + 2) * (after - w)
        w = after
    return root @ w[:-1], float(w[-1])


def _sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likelihood, by Newton's method with a small ridge."""
    target = np.where(label > 0, 1 - 1 / (2 + label.sum()), 1 / (2 + (1 - label).sum()))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * w), -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model learned from a bounded sample of `labels`; filter these before to hold rows out."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    first = lambda value, most: rows.filter(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = first(1, SAMPLE_TOXIC).unionByName(first(0, SAMPLE_CLEAN))
    sample = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "label", "_text")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    prior = min(0.5, (toxic + 0.5) / (toxic + clean + 1))
    flat = Model((), (), 0.0, 0.0, math.log(prior / (1 - prior)))
    if not toxic or not clean:
        return flat
    # Copies of a text, near ones too, tell no more than one: those that share the least of their hashed word pairs.
    words = F.split(F.lower("_text"), r"\s+")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda x, after: F.xxhash64(x, after))
    texts = sample.withColumn("_least", F.array_min(pairs)).groupBy("label", "_least").agg(F.min("_text").alias("_text")).select("label", "_text")
    kinds = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    landmarks = tuple(_telling(texts.mapInArrow(_vocabulary, "term string, toxic bigint, clean bigint"), kinds[1], kinds[0]))
    if not landmarks:
        return flat
    found = sample.mapInArrow(_training_rows(landmarks), f"_id {docs.schema[id_col].dataType.simpleString()}, label int, near array<float>").collect()  # at most 3 rows a sampled document
    near, label = np.zeros((len(found) + 1, len(landmarks))), np.zeros(len(found) + 1)
    best: dict = {}
    for k, r in enumerate(sorted(found, key=lambda r: (r["_id"], r["near"]))):
        near[k], label[k] = r["near"], r["label"]
        if r["_id"] not in best or near[best[r["_id"]]].max() < near[k].max():
            best[r["_id"]] = k
    closest = set(best.values())  # of a toxic document only the closest sentence is known to be toxic, and only if it is close
    use = np.array([k for k in range(len(label)) if not label[k] or (k in closest and near[k].max() >= 0.5)])
    weights, bias = _machine(near[use], label[use], similarities(list(landmarks), list(landmarks)))
    margins: dict = {}
    for k, r in enumerate(sorted(found, key=lambda r: (r["_id"], r["near"]))):
        margins[r["_id"]] = max(margins.get(r["_id"], (0.0, 0))[0], float(near[k] @ weights)), label[k]
    hit = list(margins.values())
    silent = [(0.0, 1.0)] * (toxic - int(sum(y for _, y in hit))) + [(0.0, 0.0)] * (clean - int(sum(1 - y for _, y in hit)))
    both = np.array(hit + silent)
    slope, shift = _sigmoid(np.clip(both[:, 0] + bias, -1, 1), both[:, 1])
    return Model(landmarks, tuple(map(float, weights)), bias, slope, shift)


def scored(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with a `score` from 0 to 1, in place of any it has: the likelihood that its text has label 1."""
    kept = [f for f in df.schema if f.name != "score"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("score", T.DoubleType())])
    return df.select(text_or_empty(text_col).alias("_scored"), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(_scores(model), schema)
