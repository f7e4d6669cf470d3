"""A quality classifier as a sparse rule ensemble over text statistics.

Statistics are column expressions. The statistics of a bounded sample of labelled rows, SAMPLE rows of
numbers at most, come to the driver. There a random forest proposes rules: every path from a root down to
a node is a conjunction of bounds. Lasso logistic regression on the rules keeps few of them, and the kept
rules with their weights become one column expression, so scoring is a scan without a shuffle or Python.

Cases: a null or empty text has zero statistics and gets a score from them. Labels other than 0 and 1 and
labels without a document are left out; of repeated labels the greater counts. Without labels of both
kinds every score is the labels' mean, 0.5 without any. Repeated rows are scored each. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty

#: At most so many labelled rows are learned from, those with the smallest hashed ids.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: Statistics that a node tries, and cuts of each.
TRIED, BINS = 4, 64
LASSO, STEPS = 0.001, 4000
SEED = 7
STATISTICS = ("chars", "words", "word_chars", "distinct_words", "capitals", "digits", "symbols", "bars", "bangs", "stops", "short_words", "long_words", "lines", "distinct_lines", "line_chars")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with a column for each of STATISTICS; shares are of the words or characters."""
    text = F.col("_text")
    rows = df.withColumn("_text", text_or_empty(text_col))
    rows = rows.withColumns({"_words": F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), "_lines": F.split(text, "\n")})
    chars, words, lines = F.length(text).cast("double"), F.size("_words").cast("double"), F.size("_lines").cast("double")
    of_chars = {"capitals": r"\p{Lu}", "digits": r"[0-9]", "symbols": r"[^\p{L}\p{N}\s.,;:!?'\"|()-]", "bars": r"\|", "bangs": "!", "stops": r"[.,;:?]"}
    numbers = {
        "chars": chars,
        "words": words,
        "word_chars": chars / (words + 1),
        "distinct_words": F.size(F.array_distinct("_words")) / (words + 1),
        **{name: F.regexp_count(text, F.lit(pattern)) / (chars + 1) for name, pattern in of_chars.items()},
        "short_words": F.size(F.filter("_words", lambda w: F.length(w) <= 3)) / (words + 1),
        "long_words": F.size(F.filter("_words", lambda w: F.length(w) >= 14)) / (words + 1),
        "lines": lines,
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "line_chars": chars / lines,
    }
    return rows.withColumns({f"s_{k}": v for k, v in numbers.items()}).drop("_text", "_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, low, high): low < value <= high holds for all of them."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = [t for name, low, high in self.bounds for t in ([F.col(f"s_{name}") > low] if low > float("-inf") else []) + ([F.col(f"s_{name}") <= high] if high < float("inf") else [])]
        return reduce(lambda a, b: a & b, tests)

    def holds(self, values: np.ndarray) -> np.ndarray:
        """For which rows of STATISTICS the rule holds."""
        out = np.ones(len(values), bool)
        for name, low, high in self.bounds:
            own = values[:, STATISTICS.index(name)]
            out &= (own > low) & (own <= high)
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self) -> Column:
        """The probability of label 1, over the columns of with_statistics()."""
        total = reduce(lambda a, x: a + F.when(x[0].column(), x[1]).otherwise(0.0), self.rules, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, least: float, path: dict, depth: int) -> list[Rule]:
    """The rules of a tree's nodes, from the one that holds these rows down; `x` has the number of cuts under each value."""
    found = [Rule(tuple((k, *v) for k, v in sorted(path.items())))] if path else []
    if not depth or not len(y) or y.min() == y.max():
        return found
    best = (0.0, 0, 0)
    for k in rng.choice(len(STATISTICS), TRIED, replace=False):
        n, good = (np.bincount(x[:, k], w, len(cuts[k]) + 1) for w in (weight, weight * y))
        left, left_good = n.cumsum()[:-1], good.cumsum()[:-1]
        right, right_good = n.sum() - left, good.sum() - left_good
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = left_good * (left - left_good) / left + right_good * (right - right_good) / right
        gain = np.where((left >= least) & (right >= least), good.sum() * (1 - good.sum() / n.sum()) - impurity, 0.0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), int(k), int(gain.argmax()))
    gain, k, at = best
    if gain <= 1e-9:
        return found
    name, cut = STATISTICS[k], float(cuts[k][at])
    low, high = path.get(name, (float("-inf"), float("inf")))
    below = x[:, k] <= at
    for side, bounds in ((below, (low, min(high, cut))), (~below, (max(low, cut), high))):
        found += _paths(x[side], y[side], weight[side], cuts, rng, least, path | {name: bounds}, depth - 1)
    return found


def _forest(values: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct rules of TREES trees, each grown on rows drawn with replacement."""
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for v in values.T]
    x = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, values.T, strict=True)], 1)
    rng = np.random.default_rng(SEED)
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        weight = rng.poisson(1.0, len(y)).astype(float)
        drawn = weight > 0
        found |= dict.fromkeys(_paths(x[drawn], y[drawn], weight[drawn], cuts, rng, max(2, len(y) // 500), {}, DEPTH))
    return list(found)


def _lasso(held: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The intercept and the weights of logistic regression on boolean columns with an L1 penalty, by accelerated proximal steps."""
    patterns, at = np.unique(np.packbits(held, axis=1), axis=0, return_inverse=True)
    n, good = (np.bincount(at.reshape(-1), w) / len(y) for w in (None, y))
    x = np.hstack([np.unpackbits(patterns, axis=1, count=held.shape[1]), np.ones((len(patterns), 1))]).astype(np.float64)
    penalty = np.array([LASSO] * held.shape[1] + [0.0])
    step = 4 / max(float(np.linalg.norm(x * np.sqrt(n)[:, None], 2)) ** 2, 1e-9)
    w = v = np.zeros(x.shape[1])
    for k in range(1, STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        moved = v - step * (x.T @ (n * p - good))
        after = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        v = after + (k - 1) / (k + 2) * (after - w)
        w = after
    return float(w[-1]), w[:-1]


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id", limit: int = SAMPLE) -> DataFrame:
    """Rows (_id, label), at most `limit`: those with the smallest hashed ids."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model learned from at most SAMPLE of `labels`; filter these before to hold rows out."""
    chosen = labelled(labels, label_col, id_col)
    texts = docs.select(F.col(id_col).alias("_id"), text_col).join(F.broadcast(chosen), "_id")
    columns = [f"s_{k}" for k in STATISTICS]
    table = with_statistics(texts, text_col).select("label", *columns).toArrow()  # at most SAMPLE rows of numbers
    data = np.stack([table.column(c).to_numpy() for c in ("label", *columns)], 1)
    data = data[np.lexsort(data.T[::-1])]  # one order for every run
    y, values = data[:, 0], data[:, 1:]
    if not len(y) or y.min() == y.max():
        p = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
        return Model(math.log(p / (1 - p)))
    rules = _forest(values, y)
    held = np.stack([r.holds(values) for r in rules], 1) if rules else np.zeros((len(y), 0), bool)
    first = np.unique(held, axis=1, return_index=True)[1]  # of rules that hold for the same rows one is enough
    rules, held = [rules[k] for k in sorted(first)], held[:, sorted(first)]
    intercept, weights = _lasso(held, y)
    return Model(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def scored(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with a `score` from 0 to 1, in place of any it has: the likelihood that its text has label 1."""
    kept = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "score")).alias("_row")
    return with_statistics(df.select(kept, F.col(text_col).alias("_scored")), "_scored").select("_row.*", model.score().alias("score"))
