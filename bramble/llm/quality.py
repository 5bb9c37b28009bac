"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted over one feature at a time, round after round, so the
sum of all trees of a feature is a lookup table over its bins; a few pairs of
features get two-way tables from what is left. A score is the sigmoid of an
intercept and the table entries of a text's bins, added up with numpy.

Training uses a bounded sample: at most `max_rows` labelled documents, those
with the smallest hash of their id. Scoring reads every whole text.

Defined results
- null text counts as empty; an empty text has all features 0 and is scored like any other.
- labels that are null, or whose document is missing, are not learned from; of repeated label or document rows one is used.
- without any usable label of each kind the score is the share of label 1, or 0.5 without labels.
- other columns are kept; a column called as the new one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample.
MAX_TRAIN_ROWS = 20_000
_BINS, _PAIR_BINS = 32, 8
_MARKS = np.frombuffer(rb"#$%&*|!@^~<>{}[]_=+\/" + b"`", dtype=np.uint8)
N_FEATURES = 15


def features(text: str | None) -> list[float]:
    """Counts and ratios over the whole text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * N_FEATURES
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, high = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[128:].sum())
    words = raw.split()
    k = max(1, len(words))
    lines = raw.split(b"\n")
    return [
        np.log1p(n),
        np.log1p(len(words)),
        min(40.0, n / k),
        upper / max(1, upper + lower),
        int(hist[48:58].sum()) / n,
        int(hist[_MARKS].sum()) / n,
        int(hist[33]) / n,
        int(hist[124]) / n,
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        len(lines) / k,
        int(hist[46] + hist[44]) / k,
        1 - len(set(lines)) / len(lines),
        high / n,
        int(hist[64] + hist[58]) / k,
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class Model:
    intercept: float
    edges: tuple[np.ndarray, ...]  # by feature: inner bin borders
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray, np.ndarray, np.ndarray], ...]  # features i, j, borders of each, table

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, ei, ej, t in self.pairs:
            total += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return _sigmoid(total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _borders(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g, h):
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of the tree over one binned feature that greedy splits give; g, h: sums of gradient and curvature by bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                more = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(more))
                if more[k] > best[0]:
                    best = (more[k], int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross-shaped split of a two-way table: its gain and leaf values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            corner = [(c[a - 1, b - 1], c[a - 1, -1] - c[a - 1, b - 1], c[-1, b - 1] - c[a - 1, b - 1], c[-1, -1] - c[a - 1, -1] - c[-1, b - 1] + c[a - 1, b - 1]) for c in (cg, ch)]
            gain = sum(x * x / (y + 1.0) for x, y in zip(*corner, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
            if gain > best:
                best, v = gain, [_leaf(x, y) for x, y in zip(*corner, strict=True)]
                out = np.zeros_like(g)
                out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return best, out


def fit_matrix(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, leaves: int = 3, n_pairs: int = 5, pair_rounds: int = 20) -> Model:
    d = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), tuple(np.empty(0) for _ in range(d)), tuple(np.zeros(1) for _ in range(d)), ())
    edges = [_borders(x[:, f], _BINS) for f in range(d)]
    codes = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    intercept = float(np.log(share / (1 - share)))
    z = np.full(len(y), intercept)
    for _ in range(rounds):
        for f in range(d):
            p = _sigmoid(z)
            k = len(tables[f])
            step = rate * _shallow_tree(np.bincount(codes[f], y - p, k), np.bincount(codes[f], p * (1 - p), k), leaves)
            tables[f] += step
            z += step[codes[f]]
    coarse = [_borders(x[:, f], _PAIR_BINS) for f in range(d)]
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def crossed(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, shape = _sigmoid(z), (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cells[i] * shape[1] + cells[j]
        return at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((-_quadrants(*crossed(i, j)[1:])[0], i, j) for i in range(d) for j in range(i + 1, d)))
    pairs = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for gain, i, j in ranked[:n_pairs] if gain < 0}
    for _ in range(pair_rounds):
        for (i, j), t in pairs.items():
            at, g, h = crossed(i, j)
            step = rate * _quadrants(g, h)[1]
            t += step
            z += step.ravel()[at]
    return Model(intercept, tuple(edges), tuple(tables), tuple((i, j, coarse[i], coarse[j], t) for (i, j), t in pairs.items()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learns from the labelled documents with the smallest id hash, at most max_rows of them."""
    sample = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "y", _features_udf()(F.col("text")).alias("x"))
        .groupBy("doc_id", "y")
        .agg(F.max("x").alias("x"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, N_FEATURES)
    return fit_matrix(x, np.array([float(r["y"] > 0) for r in rows]))


def _features_udf():
    @F.pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return compute


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1."""

    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(feature_matrix(texts)))

    return docs.withColumn(out, compute(F.col(text)))
