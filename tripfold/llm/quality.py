"""Quality scores learnt from preferences between documents (Bradley-Terry)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import bounded_sample, one_text_each, sigmoid

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"*$#%&!|~^_=<>{}[]\\@+/"
_STOPS = b".,;:?"
FEATURES = 14


def features(text: str | None) -> list[float]:
    """What a text looks like: marks, capitals, repeats, shape of words and lines. All finite.

    A text without words gives zeros but for the last, which says so.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * (FEATURES - 1) + [1.0]
    n, size = len(words), len(raw)

    def share(of: bytes) -> float:
        return (size - len(raw.translate(None, of))) / size

    letters = size - len(raw.translate(None, _LETTERS))
    capitals = size - len(raw.translate(None, _UPPER))
    lines = raw.split(b"\n")
    distinct = len(set(words))
    marks = size - len(raw.translate(None, _MARKS))
    return [
        min(1.0, marks / n),
        math.sqrt(share(_MARKS)),
        min(1.0, raw.count(b"|") * 2 / n),
        capitals / max(1, letters),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        1 - distinct / n,
        1 - math.log1p(distinct) / math.log1p(n),
        1 - len(set(lines)) / len(lines),
        share(_DIGITS),
        share(_STOPS),
        min(1.0, raw.count(b"!!") / n),
        min(30.0, (size - n) / n) / 30,
        min(1.0, math.log1p(n) / 10),
        0.0,
    ]


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    #: Raw score at the chosen quantile of the labelled documents; it gets `at` as score.
    threshold: float
    quantile: float
    at: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = x @ np.array(self.weights)
        return sigmoid(raw - self.threshold + math.log(self.at / (1 - self.at)))


def fit(x: np.ndarray, good: np.ndarray, at: float = 0.3, seed: int = 7) -> QualityModel:
    """Weights under which the preferred document of a pair scores higher.

    A pair is a good and a bad document; its loss is -log sigmoid(w (x_good - x_bad)). Steps draw
    pairs anew, seeded. The threshold is the quantile of the scores which parts the labels with
    the fewest errors. Without both labels all scores are equal, on the side of the only label.
    """
    if not len(x) or good.all() or not good.any():
        low = -1.0 if not len(x) or good.any() else 1.0
        return QualityModel((0.0,) * FEATURES, low, 0.0, at)
    rng = np.random.default_rng(seed)
    better, worse = x[good], x[~good]
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, 801):
        gap = better[rng.integers(len(better), size=2048)] - worse[rng.integers(len(worse), size=2048)]
        grad = -(gap * (1 - sigmoid(gap @ w))[:, None]).mean(axis=0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    ranked, marks = raw[order], good[order]
    # Errors if the first i are called bad; equal scores cannot be parted.
    errors = np.r_[0, np.cumsum(marks)] + np.r_[np.cumsum(~marks[::-1])[::-1], 0]
    errors = errors.astype(float)
    errors[1:-1][ranked[1:] == ranked[:-1]] = np.inf
    cut = int(np.argmin(errors))
    edge = np.r_[ranked[0] - 1, (ranked[1:] + ranked[:-1]) / 2, ranked[-1] + 1]
    return QualityModel(tuple(w.tolist()), float(edge[cut]), cut / len(raw), at)


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([features(x) for x in part])

    return made(text)


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int = 20_000, at: float = 0.3
) -> QualityModel:
    """A model from labelled documents, at most about `limit` of them, whose ids are broadcast.

    Labels other than 0 and 1 and rows with a NULL key count for nothing; a document labelled more
    than once takes its largest label; of rows that repeat an id, that of the smallest text hash
    counts.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("labelled"))
        .agg(F.max(label).alias("mark"))
    )
    known = bounded_sample(known, "labelled", limit)
    texts = docs.select(F.col(key).alias("labelled"), F.col(text).alias("body"))
    joined = one_text_each(texts.join(F.broadcast(known), "labelled"), ["labelled", "mark"], "body")
    chosen = joined.select("labelled", "mark", feature_column(F.col("body")).alias("x"))
    rows = chosen.toPandas().sort_values("labelled", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    return fit(x, rows["mark"].to_numpy() == 1, at)


def score_column(text: Column, model: QualityModel) -> Column:
    """0 to 1, higher for better texts; NULL and empty texts have a score as well."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.array([features(t) for t in part], float).reshape(-1, FEATURES)
            yield pd.Series(model.score(x))

    return scored(text)
