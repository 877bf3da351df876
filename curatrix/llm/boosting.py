"""Gradient-boosted trees on binned features, isotonic calibration, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Boosted:
    """Logistic gradient boosting over quantile bins; trees of fixed depth with Newton leaf values."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = self._bin(x)
        rate = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.base, self.forest = float(np.log(rate / (1 - rate))), []
        margin = np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (y - p), weight * p * (1 - p) + 1e-9
            node = np.zeros(len(y), dtype=np.int64)
            split = []
            for level in range(self.depth):
                size = 1 << level
                best = np.full(size, 1e-6)
                feature, cut = np.zeros(size, dtype=np.int64), np.full(size, width, dtype=np.int64)
                for f in range(x.shape[1]):
                    at = node * width + binned[:, f]
                    g, h, n = (np.bincount(at, w, size * width).reshape(size, width).cumsum(axis=1) for w in (grad, hess, None))
                    left, right = g[:, :-1], g[:, -1:] - g[:, :-1]
                    hl, hr = h[:, :-1], h[:, -1:] - h[:, :-1]
                    gain = left**2 / (hl + self.ridge) + right**2 / (hr + self.ridge) - (g[:, -1:] ** 2) / (h[:, -1:] + self.ridge)
                    gain[(n[:, :-1] < self.least) | (n[:, -1:] - n[:, :-1] < self.least)] = 0
                    at_best = gain.argmax(axis=1)
                    value = gain[np.arange(size), at_best]
                    better = value > best
                    best[better], feature[better], cut[better] = value[better], f, at_best[better]
                split.append((feature, cut))
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaves = np.bincount(node, grad, 1 << self.depth) / (np.bincount(node, hess, 1 << self.depth) + self.ridge)
            self.forest.append((split, self.rate * leaves))
            margin += self.rate * leaves[node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if x.size else np.zeros(x.shape, dtype=np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        binned, rows = self._bin(x), np.arange(len(x))
        for split, leaves in self.forest:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in split:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += leaves[node]
        return out


class Isotonic:
    """Pool-adjacent-violators; between its steps the value is interpolated."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a, b, c = blocks.pop()
                blocks[-1][0] += a
                blocks[-1][1] += b
                blocks[-1][2] += c
        # One pseudo-row of each label keeps the ends off 0 and 1.
        self.x = np.array([c / n for _, n, c in blocks])
        self.y = np.maximum.accumulate([(v + 0.05) / (n + 0.1) for v, n, _ in blocks])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


class Calibrated:
    """Boosted trees with an isotonic map fitted on out-of-fold margins; a constant where a class is missing."""

    def __init__(self, folds: int = 3, **settings):
        self.folds, self.settings, self.constant = folds, settings, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Calibrated:
        if len(y) == 0 or min(y.sum(), len(y) - y.sum()) < 2:
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        settings = {"least": int(max(2, min(8, min(y.sum(), len(y) - y.sum()) // 10)))} | self.settings
        fold = np.empty(len(y), dtype=np.int64)
        for label in (0, 1):  # every fold gets its share of both labels
            rows = np.flatnonzero(y == label)
            fold[rows] = np.arange(len(rows)) % self.folds
        held = np.zeros(len(y))
        for k in range(self.folds):
            rest = fold != k
            if 0 < y[rest].sum() < rest.sum():
                held[~rest] = Boosted(**settings).fit(x[rest], y[rest]).margin(x[~rest])
        self.model = Boosted(**settings).fit(x, y)
        self.map = Isotonic().fit(held, y)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else self.map(self.model.margin(x))


def held_out(doc_id):
    """Whether a row is held out of fitting: crc32 of the doc_id as text, mod 5, is 0 (null: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample_by_hash(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of distinct keys: those of the smallest hashes.

    Their number is counted first, and a cut-off on the hash keeps little more than `most` of them, so that the
    sort for the exact bound sees no more rows, however many tasks there are.
    """
    hashed = F.xxhash64(key, F.lit(seed))
    n = rows.count()
    if n > most:
        share = (most + 6 * most**0.5 + 100) / n
        rows = rows.where(F.pmod(hashed, F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40))))
    return rows.orderBy(F.pmod(hashed, F.lit(1 << 40)), key).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows that aren't held out, chosen by a hash of the id.

    The chosen ids are broadcast (most bounds them), so the texts of the others never move. Labels
    other than 0 and 1 and null ids are left out; an id with several labels takes its largest, one with several texts its smallest.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = sample_by_hash(usable.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("y")), "__id", most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
