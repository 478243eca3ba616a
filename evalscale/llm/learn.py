"""What the trained operators share: label samples, boosted trees, isotonic and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import cut

#: Labelled rows that a classifier is fitted on, at most; taken by hash, so evenly.
SAMPLE_ROWS = 12_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label), one row per doc_id, of the first `rows` labelled ids in hash order.

    Of contradicting labels the larger counts, of texts with one id the smallest.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by `rows`, so it may be broadcast
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return cut(found, "sample")


class Boosted:
    """Gradient-boosted regression trees of fixed depth on logistic loss, with histogram splits."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if f else np.zeros((n, 0), int)
        size = 1 << self.depth
        self.feature, self.cut, self.leaf = np.zeros((self.n, size), np.int64), np.full((self.n, size), np.inf), np.zeros((self.n, size))
        total = np.full(n, self.base)
        for t in range(self.n):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            node = np.ones(n, np.int64)  # heap numbering: children of i are 2i and 2i + 1
            for level in range(self.depth):
                first = 1 << level
                local = node - first
                best = np.full(first, 1e-9)
                where, at = np.zeros(first, np.int64), np.full(first, -1)
                tg, th = np.bincount(local, g, first), np.bincount(local, h, first)
                parent = tg * tg / (th + self.ridge)
                for j in range(f):
                    b = len(edges[j]) + 1
                    if b < 2:
                        continue
                    slot = local * b + binned[:, j]
                    sg = np.bincount(slot, g, first * b).reshape(first, b).cumsum(1)[:, :-1]
                    sh = np.bincount(slot, h, first * b).reshape(first, b).cumsum(1)[:, :-1]
                    rg, rh = tg[:, None] - sg, th[:, None] - sh
                    gain = sg * sg / (sh + self.ridge) + rg * rg / (rh + self.ridge) - parent[:, None]
                    gain[(sh < self.least / 4) | (rh < self.least / 4)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(first), k]
                    better = top > best
                    best[better], where[better], at[better] = top[better], j, k[better]
                for i in range(first):
                    if at[i] >= 0:
                        self.feature[t, first + i], self.cut[t, first + i] = where[i], edges[where[i]][at[i]]
                node = 2 * node + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node] if f else 0)
            leaf = node - size
            self.leaf[t] = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            total = total + self.leaf[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.n):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.feature[t, node]] > self.cut[t, node])
            total += self.leaf[t][node - (1 << self.depth)]
        return total


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators, as points to interpolate between; the ends keep off 0 and 1 by half a case.  A weight is a number of cases."""
    weight = np.ones(len(score)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
    for s, label, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([label * w, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    xs = np.array([b[2] / b[1] for b in blocks])
    ys = np.array([(b[0] + 0.5 * (b[0] / b[1] if 0 < b[0] < b[1] else 0.5)) / (b[1] + 0.5) if b[0] else 0.25 / (b[1] + 0.5) for b in blocks])
    return xs, np.maximum.accumulate(np.clip(ys, 0, 1))


def apply_isotonic(points: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Interpolated, and strictly rising beyond the ends by a hair, so that order is kept."""
    xs, ys = points
    out = np.interp(score, xs, ys)
    return np.clip(out + 1e-4 * (1 / (1 + np.exp(-score)) - 0.5), 0, 1)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression on one score, by Newton steps with a little ridge."""
    w = np.zeros(2)
    x = np.stack([score, np.ones_like(score)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
