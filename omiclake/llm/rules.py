"""Operator 6: quality rules. Counted rules first, then a trained verdict.

The verdict is a logistic regression over hashed word n-grams (single words, pairs, and whether a word
repeats the one before) and hashed character n-grams (four bytes), as shares of a text's n-grams. It is
fitted by AdaGrad on a bounded sample of labelled rows, calibrated by Platt scaling on a part of
the sample that the fit didn't see, and compared with a fixed threshold, in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from omiclake.llm.common import by_text, documents, mixed, small_batches
from omiclake.llm.labelled import labelled_texts
from omiclake.llm.textstats import Text

#: Rows that the regression is fitted on, at most.
SAMPLE = 6000
#: A text is kept if its calibrated probability of label 1 is so high.
KEEP = 0.3
BITS = 17
#: Shares are multiplied by this, so that a step moves the score of a usual text noticeably.
SCALE = 20.0
FAMILIES = 3


def ngrams(t: Text) -> list[np.ndarray]:
    """Bucket numbers: of words, of word pairs, of four-byte strings."""
    cut, h = np.uint64(64 - BITS), t.hash
    pair = mixed(h[:-1] * np.uint64(3) + mixed(h[1:]))
    pair[h[1:] == h[:-1]] = np.uint64(0)
    d = t.data.astype(np.uint32)
    four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24) if len(d) > 3 else d[:0]
    parts = [(h >> cut).astype(np.int64), (pair >> cut).astype(np.int64), ((four * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)]
    return [x + (i << BITS) for i, x in enumerate(parts)]


def sparse(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's features."""
    at, value = [], []
    for x in ngrams(t):
        if len(x):
            u, c = np.unique(x, return_counts=True)
            at.append(u)
            value.append(c * (SCALE / len(x)))
    return (np.concatenate(at), np.concatenate(value)) if at else (np.zeros(0, np.int64), np.zeros(0))


def logit(t: Text, weights: np.ndarray, bias: float) -> float:
    return bias + sum(SCALE * float(weights[x].mean()) for x in ngrams(t) if len(x))


class Model:
    """Weights, bias, and the calibration p = sigmoid(a * logit + b)."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float) -> None:
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def probability(self, t: Text) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * logit(t, self.weights, self.bias) + self.b, -50, 50))))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset by Newton's method on smoothed targets; a step that doesn't lower the loss is halved."""
    n1, n0 = y.sum(), (1 - y).sum()
    to = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(at: np.ndarray) -> float:
        u = at[0] * z + at[1]
        return float((np.logaddexp(0, u) - to * u).sum() + 1e-3 * (at[0] - 1) ** 2 / 2 + 1e-3 * at[1] ** 2 / 2)

    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -50, 50)))
        w = p * (1 - p)
        g = np.array([((p - to) * z).sum() + 1e-3 * (at[0] - 1), (p - to).sum() + 1e-3 * at[1]])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step, before = np.linalg.solve(hess, g), loss(at)
        while np.abs(step).max() > 1e-9 and loss(at - step) > before:
            step = step / 2
        at = at - step
        if np.abs(step).max() <= 1e-9:
            break
    return float(max(at[0], 1e-2)), float(at[1])


def packed(at: np.ndarray, value: np.ndarray) -> bytes:
    """A text's features, compressed: the steps between ascending buckets, and the values as 32-bit floats."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + value.astype(np.float32).tobytes())


def unpacked(z: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(z)
    half = len(data) // 2
    return np.cumsum(np.frombuffer(data[:half], np.int32), dtype=np.int64), np.frombuffer(data[half:], np.float32)


class Packed(Sequence):
    """Rows for fit, each unpacked when it is asked for."""

    def __init__(self, rows: list[tuple[bytes, int]]) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        z, label = self.rows[i]
        return *unpacked(z), label

    def labels(self) -> list[int]:
        return [label for _, label in self.rows]


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-5) -> Model:
    """rows: buckets, values and label, in a fixed order. Every fifth calibrates. Without both labels, all is kept."""
    y = np.array(rows.labels() if isinstance(rows, Packed) else [r[2] for r in rows], float)
    weights, bias = np.zeros(FAMILIES << BITS), 0.0
    if len(set(y.tolist())) < 2:
        return Model(weights, 50.0 if not len(y) or y[0] == 1 else -50.0, 1.0, 0.0)
    learn, check = [i for i in range(len(rows)) if i % 5], [i for i in range(len(rows)) if i % 5 == 0]
    square, square_b = np.full(len(weights), 1e-8), 1e-8
    rng = np.random.default_rng(6)
    balance = {v: len(learn) / (2 * max(1, sum(y[i] == v for i in learn))) for v in (0, 1)}
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, value, label = rows[i]
            p = 1 / (1 + np.exp(-np.clip(bias + (weights[at] * value).sum(), -50, 50)))
            g = (p - label) * balance[label]
            step = g * value + l2 * weights[at]
            square[at] += step * step
            weights[at] -= rate * step / np.sqrt(square[at])
            square_b += g * g
            bias -= rate * g / np.sqrt(square_b)
    z = np.array([bias + (weights[rows[i][0]] * rows[i][1]).sum() for i in check])
    a, b = platt(z, y[check]) if len(set(y[check].tolist())) == 2 else (1.0, 0.0)
    return Model(weights, float(bias), a, b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample; its features are made on the executors."""

    def run(texts: list[bytes]) -> dict:
        x = [sparse(Text(t)) for t in texts]
        return {"z": pa.array([packed(*a) for a in x], pa.binary()), "a": pa.array([zlib.crc32(a.astype(np.int32).tobytes()) for a, _ in x], pa.int64()), "v": pa.array([zlib.crc32(v.astype(np.float32).tobytes()) for _, v in x], pa.int64())}

    # The driver holds the sample's features compressed, and unpacks a text's when the fit meets it.
    got = by_text(labelled_texts(docs, labels, "quality", sample), run, "z binary, a bigint, v bigint", ("doc_id", "y")).toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "y", "a", "v", "z")), strict=True))
    del got
    pa.default_memory_pool().release_unused()
    return fit(Packed([(z, y) for _, y, _, _, z in rows]))


def judged(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, the five counts, base_failed, probability and kept, for every whole text (null: empty).

    Empty texts and texts of under 50 words fail the counted rules. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> dict:
        m, rows = shared.value, []
        for x in texts:
            t = Text(x)
            n, again = t.n_words, t.n_repeat_words()
            failed = n < 50 or 100 * again > 50 * n
            p = m.probability(t)
            rows.append((n, t.word_chars(), t.n_symbols(), t.n_dup_lines(), again, failed, p, not failed and p >= keep))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return {k: pa.array(v, kind) for k, v, kind in zip(names, zip(*rows, strict=True), kinds, strict=True)}

    return by_text(docs, run, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean")


def kept_documents(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names; nothing is shuffled.

    Null and empty texts, and texts of under 50 words, go. Rows that repeat are judged each, alike. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            if b.num_rows:
                ok = []
                for x in b.column(at).to_pylist():
                    t = Text((x or "").encode())
                    n = t.n_words
                    ok.append(n >= 50 and 100 * t.n_repeat_words() <= 50 * n and m.probability(t) >= keep)
                yield b.filter(pa.array(ok))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
