"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for vectorised traversal."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orospark.llm.common import map_texts, table
from orospark.llm.toxicity import is_held_out, training_sample

#: Labelled documents that the trees are fitted on at most: a sample chosen by a hash of the key.
FIT_DOCS = 30_000
TREES, DEPTH, BINS, RATE = 120, 4, 64, 0.1
LEAST_ROWS, RIDGE = 20, 1.0
THRESHOLD = 0.3

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"|", b"$%&#*", b"\"'()[]{}<>", b"-_/\\=+~^@:;`", bytes(range(128, 256))]
_GROUP = np.zeros((256, len(_GROUPS)))
for _k, _g in enumerate(_GROUPS):
    _GROUP[list(_g), _k] = 1
NAMES = ("log_bytes", "log_words", *(f"share_{k}" for k in range(len(_GROUPS))), "word_length", "distinct_words", "same_as_before", "same_as_two_before", "log_lines", "distinct_lines", "line_length", "long_words", "letter_entropy", "ends_marked", "single_letters", "most_common_pair")


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a whole text; all defined for an empty one."""
    b = text or b""
    n = len(b)
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    shares = (counts @ _GROUP) / max(n, 1)
    w = b.split()
    m = max(len(w), 1)
    lines = [x for x in b.split(b"\n") if x]
    k = max(len(lines), 1)
    letters = counts[97:123].astype(float)
    p = letters[letters > 0] / max(letters.sum(), 1.0)
    lengths = list(map(len, w))
    bigrams = len(set(zip(w, w[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(len(w)), *shares.tolist(), sum(lengths) / m, len(set(w)) / m, sum(map(eq, w, w[1:])) / m, sum(map(eq, w, w[2:])) / m,
        math.log1p(len(lines)), len(set(lines)) / k, math.log1p(n / k), sum(x > 12 for x in lengths) / m, float(-(p * np.log(p)).sum()),
        float(b.rstrip()[-1:] in (b".", b"!", b"?")), lengths.count(1) / m, bigrams / m,
    ]


@dataclass
class Trees:
    """Complete binary trees of equal depth in arrays: feature and cut of each inner node, value of each leaf."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray
    value: np.ndarray  # (trees, 2^depth)
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees at once, level by level."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        while inner and (at < inner).any():
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.bias + self.value[trees, at - inner].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees on the logistic loss; splits are looked for in histograms of quantile bins."""
    n, d = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate0 = float(np.clip((y.sum() + 1) / (n + 2), 1e-4, 1 - 1e-4))
    bias = math.log(rate0 / (1 - rate0))
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n < 2 or y.min() == y.max():
        return Trees(feature[:0], cut[:0], value[:0], bias)
    edges = np.stack([np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]) for k in range(d)])
    binned = np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(d)])
    offset = (np.arange(d) * bins)[:, None]
    margin = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            key = (node[None] * d * bins + offset + binned).ravel()
            size = width * d * bins
            sums = [np.bincount(key, np.tile(v, d), size).reshape(width, d, bins).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
            gain = gain[:, :, :-1].reshape(width, -1)
            best = gain.argmax(1)
            f, b = best // (bins - 1), best % (bins - 1)
            real = gain[np.arange(width), best] > 1e-9
            feature[t, width - 1 : 2 * width - 1] = f
            cut[t, width - 1 : 2 * width - 1] = np.where(real, edges[f, b], np.inf)
            node = 2 * node + (x[np.arange(n), f[node]] > cut[t, width - 1 + node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = rate * gs / (hs + RIDGE)
        margin += value[t][node]
    return Trees(feature, cut, value, bias)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Trees:
    """Trees from the labels of documents that are not held out; only their statistics reach the driver."""
    sample = training_sample(docs, labels, "quality", fit_docs, text, key)
    rows = map_texts(sample, lambda: lambda texts: [[statistics(t) for t in texts]], [T.StructField("x", T.ArrayType(T.DoubleType()))], "text", keep_text=False).toArrow()
    x, y = np.array(rows.column("x").to_pylist()).reshape(-1, len(NAMES)), np.asarray(rows.column("y").to_pylist(), float)
    order = np.lexsort([*x.T, y])
    return fit_trees(x[order], y[order])


def score_documents(docs: DataFrame, trees: Trees, text: str = "text", keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted, from whole texts however long. Null and empty texts have statistics too; repeated
    rows are scored each; clashing columns go; without training labels all scores are one half; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        trees = shared.value

        def f(texts):
            score = trees.probability(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return f

    return map_texts(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text, keep_text)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of each document; odd rows as in score_documents()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
