"""Operator 3: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics come from the text alone. They are cut into at most 64 bins at quantiles of the sample; each
tree grows level by level from histograms of gradients; the trees are flattened into arrays, which
scoring walks for a whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omiclake.llm.common import by_text, documents, fold
from omiclake.llm.labelled import labelled_texts
from omiclake.llm.textstats import FEATURES, features

#: Rows that the trees are fitted on, at most.
SAMPLE = 20_000
#: Predicted 1 from this score on.
CUT = 0.3


class Trees:
    """Perfect binary trees of one depth: node i's children are 2i + 1 and 2i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float) -> None:
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        n, inner = len(x), self.feature.shape[1] if self.feature.size else 0
        z, row = np.full(n, self.base), np.arange(n)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(n, np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            z += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """x: rows by features; y: 0 or 1. Without rows of both labels the score is constant."""
    n, m = x.shape
    rate1 = y.mean() if n else 0.5
    base = float(np.log((rate1 * n + 1) / ((1 - rate1) * n + 1)))
    none = Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), base)
    if n < 2 or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = code + np.arange(m) * bins
    z, inner, out = np.full(n, base), 2**depth - 1, ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (m * bins) + flat).ravel()
            hist = [np.bincount(slot, np.repeat(v, m), width * m * bins).reshape(width, m, bins) for v in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            for k in range(width):
                j, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = np.zeros(inner + 1)
        gs, hs = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf[:] = -rate * gs / (hs + l2)
        z += leaf[at - inner]
        for a, v in zip(out, (feature, threshold, leaf), strict=True):
            a.append(v)
    return Trees(*map(np.array, out), base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fits on a bounded sample of labelled rows outside fold 0; statistics are made on the executors."""

    def run(texts: list[bytes]) -> dict:
        return {"x": pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))}

    rows = sorted(by_text(labelled_texts(docs, labels, label, sample), run, "x array<double>", ("doc_id", "y")).collect(), key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], float))


def scored(docs: DataFrame, model: Trees, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> dict:
        p = shared.value.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
        return {"score": pa.array(p), "predicted": pa.array((p >= cut).astype(np.int32))}

    out = by_text(docs, run, "score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
