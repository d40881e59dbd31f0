"""Labelled samples and histogram gradient boosting in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, low_hashes, text_or_empty


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``most`` labelled documents outside the held-out part, half of them of either label: rows doc_id, text, label (double).

    The ids are drawn by hash, before any text is read; where there are many, those with high
    hashes don't come to the draw. Being at most ``most`` rows of two numbers, they are broadcast
    to the documents. An id with several labels has their mean, one with several texts the least.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    rows = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.avg(label).alias("label"))
    hashed, parts = F.xxhash64("__id"), (F.col("label") >= 0.5, F.col("label") < 0.5)
    counts = rows.agg(*(F.count_if(part) for part in parts)).first()
    drawn = [low_hashes(rows.where(part), hashed, (most + 100) / max(1, n)).orderBy(hashed, "__id").limit(most // 2) for part, n in zip(parts, counts, strict=True)]
    ids = drawn[0].union(drawn[1])
    found = docs.select(column(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all trees are walked at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Gradient boosting for the log loss on histograms of at most ``bins`` quantile bins a feature."""
    n, k = x.shape if x.ndim == 2 else (0, 1)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots: list[int] = []
    if n and y.min() < y.max():
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        shifted = binned + np.arange(k) * bins
        total = np.full(n, base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.full(n, len(nodes))
            roots.append(len(nodes))
            nodes.append([0, 0, len(nodes), len(nodes), 0.0])
            level = [len(nodes) - 1]
            for d in range(depth + 1):
                nxt = []
                for node in level:
                    mine = np.flatnonzero(at == node)
                    g, h = grad[mine].sum(), hess[mine].sum()
                    nodes[node][4] = -rate * g / (h + ridge)
                    if d == depth or len(mine) < 2 * least:
                        continue
                    flat = shifted[mine].ravel()
                    hist = [np.bincount(flat, np.repeat(v[mine], k) if v is not None else None, k * bins).reshape(k, bins).cumsum(axis=1) for v in (grad, hess, None)]
                    gl, hl, cl = hist
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                    gain[(cl < least) | (len(mine) - cl < least)] = -np.inf
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if not gain[j, b] > 1e-6 or b >= len(edges[j]):
                        continue
                    left, right = len(nodes), len(nodes) + 1
                    nodes += [[0, 0, left, left, 0.0], [0, 0, right, right, 0.0]]
                    nodes[node][:4] = [int(j), float(edges[j][b]), left, right]
                    at[mine] = np.where(binned[mine, j] <= b, left, right)
                    nxt += [left, right]
                level = nxt
            total += np.array([v[4] for v in nodes])[at]
    if not roots:
        nodes, roots = [[0, 0, 0, 0, 0.0]], [0]
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), depth, base)
