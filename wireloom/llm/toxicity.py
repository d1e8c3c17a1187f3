"""Toxicity: a linear classifier over character n-grams whose presence features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import labelled
from wireloom.llm.store import fold
from wireloom.llm.words import distinct, mixed

BITS = 18
ORDERS = (3, 4, 5)
SLICE = 1 << 20
#: Buckets of sampled texts that the fit widens to eight bytes and more at a time.
BLOCK = 1 << 19


def features(text: str) -> np.ndarray:
    """Sorted hash buckets of the character 3- to 5-grams present in the lower-cased text; long texts go slice by slice, whole."""
    text = text.lower()
    found = []
    for start in range(0, max(1, len(text)), SLICE):
        c = np.frombuffer(text[start : start + SLICE + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = c.copy()
        for n in range(2, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
            if n in ORDERS:
                found.append((mixed(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.uint32))
    return distinct(np.concatenate(found)) if found else np.empty(0, np.uint32)


def _blocks(xs: list[np.ndarray], used: np.ndarray):
    """A function that gives (slice of texts, their used buckets, text of each bucket within the slice), about BLOCK buckets of whole texts at a time.

    Only the buckets stay in memory, in four bytes each; everything as wide as that is made for one block and dropped.
    """
    kept = [x[used[x]].astype(np.uint32) for x in xs]
    cuts, size = [0], 0
    for k, x in enumerate(kept):
        if size and size + len(x) > BLOCK:
            cuts.append(k)
            size = 0
        size += len(x)
    cuts.append(len(kept))

    def run():
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield slice(a, b), np.concatenate(kept[a:b]).astype(np.int64), np.repeat(np.arange(b - a), [len(x) for x in kept[a:b]])

    return run


def fit(xs: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, l2: float = 1e-4, rounds: int = 60, seen: int = 8) -> np.ndarray:
    """Weights by bucket (log-count ratio times fitted coefficient), then the intercept; one class alone gives its prior.

    Buckets in fewer than ``seen`` sampled texts are left out. With p and q the smoothed document counts of a bucket in either class, r = log(p / |p|) - log(q / |q|); logistic regression on x = r
    for present buckets, by accelerated gradient descent on the whole sample.
    """
    size = 1 << BITS
    w = np.zeros(size + 1)
    if not len(xs):
        return w
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w[size] = prior
    if y.min() == y.max():
        return w
    in_one, in_all = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for x, mark in zip(xs, y, strict=True):  # a text's buckets are distinct
        in_all[x] += 1
        if mark == 1:
            in_one[x] += 1
    p, q = alpha + in_one, alpha + (in_all - in_one)
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[p + q - 2 * alpha < seen] = 0
    squares = r * r
    blocks, norms = _blocks(xs, r != 0), np.zeros(len(xs))
    for rows, flat, row in blocks():
        norms[rows] = np.bincount(row, squares[flat], len(norms[rows]))
    step = 4.0 / (norms.mean() + 1)
    beta, last, b, last_b = np.full(size, 0.0), np.zeros(size), prior, prior
    for k in range(rounds):
        m = k / (k + 3)
        at, at_b = beta + m * (beta - last), b + m * (b - last_b)
        margins, gradient, e = r * at, np.zeros(size), np.empty(len(y))
        for rows, flat, row in blocks():  # both passes over a block in one go: a row lies in one block
            z = np.bincount(row, margins[flat], len(y[rows])) + at_b
            e[rows] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(y)
            np.add.at(gradient, flat, r[flat] * e[rows][row])
        last, last_b = beta, b
        beta = at - step * (gradient + l2 * at)
        b = at_b - min(step, 1.0) * e.sum()
    w[:size], w[size] = r * beta, b
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = 5000, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> np.ndarray:
    """Fits on at most ``rows`` labelled texts outside the held-out fifth."""
    chosen = labelled.sample(docs, labels, label, fold(id_col, 5) != 0, rows, id_col, text_col)
    return labelled.fitted(chosen, features, fit, (1 << BITS) + 1)


def margin_of(w: np.ndarray):
    return lambda text: float(w[features(text)].sum(dtype=np.float64) + w[-1])


def toxicity(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher is more toxic), predicted (score >= 0.5).

    A null text is scored as the empty one, which gets the intercept alone. A null id counts as the empty text for ``held_out``. Repeated
    rows get equal results. Without labelled rows every score is 0.5. Other columns are ignored.
    """
    out = labelled.scored(docs, margin_of(model), id_col, text_col, fold(id_col, 5) == 0)
    return out.select(F.col("i").alias(id_col), F.col("k").alias("held_out"), F.col("s").alias("score"), F.col("p").alias("predicted"))


def without_toxic(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``."""
    margin = margin_of(model)
    return labelled.kept_rows(docs, lambda t: labelled.probability(margin(t)) < threshold, text_col)
