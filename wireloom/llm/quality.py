"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import labelled
from wireloom.llm.store import fold
from wireloom.llm.words import WordHashes, distinct, mixed, ngrams, words

BITS = 20
_hashes = WordHashes()


def features(text: str) -> np.ndarray:
    """Sorted hash buckets of the words and word pairs present."""
    h = _hashes.of(words(text))
    both = np.concatenate([mixed(h), mixed(ngrams(h, 2) + np.uint64(2))]) if len(h) else h
    return distinct((both >> np.uint64(64 - BITS)).astype(np.uint32))


def _scale(n: int) -> float:
    return 1.0 / np.sqrt(n) if n else 0.0


def fit(xs: list[np.ndarray], y: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.005, l2: float = 0.1, epochs: int = 5) -> np.ndarray:
    """FTRL-proximal: per coordinate z and n; a weight is zero while |z| <= l1. Rows have unit length; the last weight is the intercept."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            i = np.append(xs[k], size).astype(np.int64)
            x = np.full(len(i), _scale(len(i) - 1))
            x[-1] = 1.0
            w = weights(i)
            g = (labelled.probability(float(w @ x)) - y[k]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def train(docs: DataFrame, labels: DataFrame, rows: int = 10000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> np.ndarray:
    """Fits on at most ``rows`` labelled texts outside the held-out third."""
    chosen = labelled.sample(docs, labels, label, fold(id_col, 3) != 1, rows, id_col, text_col)
    return labelled.fitted(chosen, features, fit, (1 << BITS) + 1)


def margin_of(w: np.ndarray):
    def margin(text: str) -> float:
        i = features(text)
        return float(w[i].sum(dtype=np.float64) * _scale(len(i)) + w[-1])

    return margin


def quality(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher is better), predicted (score >= 0.5).

    A null text is scored as the empty one, which gets the intercept alone. A null id counts as the empty text for ``held_out``. Repeated
    rows get equal results. Without labelled rows every score is 0.5. Other columns are ignored.
    """
    out = labelled.scored(docs, margin_of(model), id_col, text_col, fold(id_col, 3) == 1)
    return out.select(F.col("i").alias(id_col), F.col("k").alias("held_out"), F.col("s").alias("score"), F.col("p").alias("predicted"))
