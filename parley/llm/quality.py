"""Operator 1: quality classifier, gradient-boosted trees over document statistics.

Features are bounded statistics of the whole text (ratios of character classes,
repetition of words, word pairs and lines, lengths on a log scale). They are
binned by quantiles, trees are grown level by level from histograms of gradients,
and the forest is flattened into arrays in heap order, so that a whole batch
walks all trees at once by numpy indexing.

Only the fit takes a bounded sample of the labelled rows (``MAX_LABELLED``); all
documents are scored.

Defined results: a null or empty text has all-zero statistics and gets the score
the trees give to those; long texts count whole; repeated rows get equal scores;
rows with a null id are scored, and are neither held out nor learned from. With
no usable label at all the score is 0.5 and the filter keeps every row. Extra
columns are kept by the filter and never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, fresh, labelled_ids, labelled_texts

#: At most about so many labelled rows are learned from.
MAX_LABELLED = 12_000
THRESHOLD = 0.7

_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def _byte_classes() -> np.ndarray:
    """256 x classes: which byte belongs to which character class (UTF-8 bytes from 128 on are one class)."""
    classes = (
        lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b == 32, lambda b: b == 10,
        lambda b: b >= 128, lambda b: chr(b) in ".,;:?'\"()-", lambda b: chr(b) in "#*$%&<>", lambda b: b == 33,
        lambda b: b == 124, lambda b: b < 32 and b != 10, lambda b: chr(b) in "@/\\_=+{}[]~^`",
    )
    return np.array([[float(f(b)) for f in classes] for b in range(256)])


CLASSES = _byte_classes()
N_FEATURES = CLASSES.shape[1] + 9


def document_statistics(texts: list[str | None]) -> np.ndarray:
    """One row of N_FEATURES bounded statistics per text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    k = CLASSES.shape[1]
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        out[i, :k] = np.bincount(raw, minlength=256) @ CLASSES / len(raw)
        w = _words(text)
        n = len(w)
        lines = [x for x in text.split("\n") if x.strip()]
        out[i, k] = np.log1p(len(text))
        out[i, k + 1] = np.log1p(n)
        if n:
            out[i, k + 2] = min(len(text) / n, 100.0)
            out[i, k + 3] = len(set(w)) / n
            out[i, k + 4] = len(set(zip(w, w[1:]))) / n
            out[i, k + 5] = sum(map(eq, w, w[1:])) / n
            out[i, k + 6] = len(set(zip(w, w[1:], w[2:], w[3:]))) / n
        if lines:
            out[i, k + 7] = len(set(lines)) / len(lines)
            out[i, k + 8] = np.log1p(n / len(lines))
    return out


@dataclass
class Forest:
    """Trees of one depth in heap order: node i has children 2i+1 and 2i+2."""

    bias: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; +inf sends everything left
    value: np.ndarray  # trees x leaves
    trained: bool

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.bias)
        if not trees:
            return total
        tree = np.arange(trees)
        for a in range(0, len(x), 4096):  # bounded memory
            part = x[a:a + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            while node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.cut[tree, node])
            total[a:a + 4096] += self.value[tree, node - inner].sum(axis=1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
               ridge: float = 1.0, least_hessian: float = 1.0) -> Forest:
    """Histogram gradient boosting with logistic loss."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    empty = np.zeros((0, inner)), np.zeros((0, leaves))
    if not len(y) or y.min() == y.max():
        known = len(y) > 0
        p = (y.sum() + 1) / (len(y) + 2) if known else 0.5
        return Forest(float(np.log(p / (1 - p))), empty[0].astype(np.int64), empty[0], empty[1], known)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = y.mean()
    bias = float(np.log(p0 / (1 - p0)))
    raw = np.full(len(y), bias)
    n_feat = x.shape[1]
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    rows = np.arange(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = node - first
            size = width * bins
            g = np.stack([np.bincount(local * bins + binned[:, j], grad, size) for j in range(n_feat)]).reshape(n_feat, width, bins)
            h = np.stack([np.bincount(local * bins + binned[:, j], hess, size) for j in range(n_feat)]).reshape(n_feat, width, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            gain[(hl < least_hessian) | (ht - hl < least_hessian)] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            pick = best.argmax(axis=1)
            ok = best[np.arange(width), pick] > 1e-9
            j, b = pick // bins, pick % bins
            feature[t, first:first + width] = np.where(ok, j, 0)
            for k in np.flatnonzero(ok):
                cut[t, first + k] = cuts[j[k]][b[k]] if b[k] < len(cuts[j[k]]) else np.inf
            node = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[t] = -rate * g / (h + ridge)
        raw += value[t][leaf]
    return Forest(bias, feature, cut, value, True)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_rows: int = MAX_LABELLED) -> Forest:
    """Fit on a bounded sample of labelled documents; the statistics are computed by tasks."""
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = document_statistics(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": list(x.astype(np.float64))})

    sample = labelled_texts(docs, labelled_ids(labels, label, learn, max_rows, salt=1))
    rows = sample.select("doc_id", "text", "label").mapInPandas(features, "doc_id long, label double, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))  # the same fit whatever the order of tasks
    return fit_forest(np.array([r.x for r in rows], np.float32).reshape(-1, N_FEATURES), np.array([r.label for r in rows]))


def score_column(forest: Forest, text: Column) -> Column:
    """Score of each text, between 0 and 1."""
    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        return pd.Series(forest.score(document_statistics(batch.tolist())))

    return scored(text)


def score_documents(docs: DataFrame, forest: Forest, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    s = docs.select("doc_id", score_column(forest, F.col("text")).alias("score"))
    return s.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, all columns kept."""
    if not forest.trained:
        return docs
    name = fresh(docs, "score")
    return docs.withColumn(name, score_column(forest, F.col("text"))).where(F.col(name) >= THRESHOLD).drop(name)
