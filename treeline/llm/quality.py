"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes about two dozen numbers (lengths, shares of kinds of
bytes, repetition of words and lines, shape of words), taken over its whole
text from byte arrays of a block of documents. Trees are grown on 64-bin
histograms of the features by the gain of the logistic loss, then flattened
into arrays (feature, threshold, left, right, value), so a block of documents
walks all trees in a few numpy calls per level.

Training is numpy on the driver, on the features of at most ``max_rows``
labelled documents of the smallest hash of doc_id: a bounded few MB however
large the corpus is. Every text is scored whole.

Defined cases: null and empty texts have all-zero features and are scored by
them. Rows without a label aren't trained on; a null doc_id is scored, with
held_out false. With no labelled row, or one class only, the score is the
smoothed rate of the class, 0.5 without any label. Repeated rows are scored
each. Very long texts are worked on whole, a text at a time. Of equal gains the
first feature and bin is taken. An empty table gives no rows. ``score`` keeps
other columns; those named ``score`` or ``predicted`` are replaced by its
results, and null texts score like empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import unlike, with_results
from treeline.llm.shingles import blocks, mix, word_hashes
from treeline.llm.toxicity import fold, labelled

_LINES = np.arange(256) == 10
_KINDS = {
    "upper": lambda c: 65 <= c <= 90,
    "lower": lambda c: 97 <= c <= 122,
    "digit": lambda c: 48 <= c <= 57,
    "space": lambda c: c == 32,
    "line": lambda c: c == 10,
    "stop": lambda c: c in b".!?",
    "comma": lambda c: c in b",;:",
    "mark": lambda c: c in b"!?",
    "bar": lambda c: c in b"|\t<>{}[]()=/\\_",
    "symbol": lambda c: c in b"#$%&*@+^~`",
    "wide": lambda c: c >= 128,
}
_TABLE = np.array([[f(c) for c in range(256)] for f in _KINDS.values()], dtype=np.uint8)
FEATURES = ("log_bytes", "log_words", "bytes_per_word", "word_std", "distinct", "top_share", "same_next", "pair_distinct", "lines", "line_distinct", "words_per_line", "words_per_stop", "upper_word", *_KINDS)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float64)
    for first, raws in blocks(texts, 1 << 19):
        sizes = np.array([len(r) for r in raws])
        words, at = word_hashes(raws)
        lines, line_at = word_hashes(raws, _LINES)
        flat = np.frombuffer(b" ".join([*raws, b""]) or b" ", dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        counts = np.zeros((len(raws), len(_KINDS)))
        for j, kind in enumerate(_TABLE):
            counts[:, j] = np.add.reduceat(kind[flat], bounds[:-1], dtype=np.int64)
        counts[:, 3] -= 1  # the separator after each text
        letters = np.concatenate([[0], np.cumsum((flat != 32) & ((flat < 9) | (flat > 13)))])
        for i in range(len(raws)):
            if not sizes[i]:
                continue
            row = out[first + i]
            mine = words[at[i] : at[i + 1]]
            n = len(mine)
            size = float(sizes[i])
            row[0] = np.log1p(size)
            row[1] = np.log1p(n)
            row[13:] = counts[i] / size
            if not n:
                continue
            row[2] = (letters[bounds[i + 1]] - letters[bounds[i]]) / n
            _, often = np.unique(mine, return_counts=True)
            row[4] = len(often) / n
            row[5] = often.max() / n
            if n > 1:
                row[6] = (mine[1:] == mine[:-1]).mean()
                row[7] = len(np.unique(mix(mine[1:]) + mine[:-1])) / (n - 1)
            own = lines[line_at[i] : line_at[i + 1]]
            row[8] = np.log1p(len(own))
            row[9] = len(np.unique(own)) / max(1, len(own))
            row[10] = n / max(1, len(own))
            row[11] = n / (1 + counts[i, 5])
            row[12] = counts[i, 0] / n
        np.maximum(out[first : first + len(raws)], 0, out=out[first : first + len(raws)])
    return out


@dataclass
class BoostedTrees:
    """Trees flattened one after the other; a node without a feature (-1) is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
        return self.prior + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50))) if len(self.roots) else np.full(len(x), 1 / (1 + np.exp(-self.prior)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> BoostedTrees:
        y = np.asarray(y, dtype=np.float64)
        share = (y.sum() + 1) / (len(y) + 2)
        nodes: list[list] = []
        roots: list[int] = []
        prior = float(np.log(share / (1 - share)))
        if len(y) and y.min() != y.max():
            edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
            codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.int64)
            offset = np.arange(x.shape[1]) * bins
            raw = np.full(len(y), prior)

            def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int) -> int:
                at = len(nodes)
                g, h = grad[rows].sum(), hess[rows].sum()
                nodes.append([-1, 0.0, at, at, -rate * g / (h + l2)])
                if level == depth or len(rows) < 2 * min_rows:
                    return at
                flat = (codes[rows] + offset).ravel()
                width = x.shape[1] * bins
                cum = [np.bincount(flat, None if w is None else np.repeat(w[rows], x.shape[1]), width).reshape(-1, bins).cumsum(1) for w in (grad, hess, None)]
                gl, hl, nl = cum
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(nl < min_rows) | (len(rows) - nl < min_rows)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] <= 1e-6:
                    return at
                go = codes[rows, j] <= b
                nodes[at][:2] = [int(j), float(edges[j][b])]
                nodes[at][2] = grow(rows[go], grad, hess, level + 1)
                nodes[at][3] = grow(rows[~go], grad, hess, level + 1)
                return at

            for _ in range(trees):
                p = 1 / (1 + np.exp(-raw))
                first = len(nodes)
                roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0))
                last = [np.array(c) for c in zip(*nodes[first:], strict=True)]
                one = cls(last[0].astype(np.int64), last[1], last[2].astype(np.int64) - first, last[3].astype(np.int64) - first, last[4], np.array([0]), 0.0, depth)
                raw += one.raw(x)
        cols = [np.array(c) for c in zip(*nodes, strict=True)] or [np.empty(0)] * 5
        return cls(cols[0].astype(np.int64), cols[1], cols[2].astype(np.int64), cols[3].astype(np.int64), cols[4], np.array(roots, dtype=np.int64), prior, depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = features(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())), part.column(2)], ["doc_id", "x", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", may: Column | None = None, max_rows: int = 8000, **fit) -> BoostedTrees:
    """Trees from at most max_rows labelled documents; ``may`` says which doc_ids may be learned from."""
    rows = labelled(docs, labels, label, F.lit(True) if may is None else may, max_rows)
    made = rows.mapInArrow(_features, "doc_id long, x array<double>, label int")
    # Repeated doc_ids can be more rows than labels: bounded again, before anything goes to the driver.
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("x")).limit(max_rows).toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return BoostedTrees.fit(x, got.column("label").to_numpy(), **fit)


def score(docs: DataFrame, model: BoostedTrees, threshold: float = 0.7) -> DataFrame:
    """All columns of docs with score and predicted, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of trees
    spot = unlike(docs.columns, ("score", "predicted")).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = shared.value.score(features(part.column(spot).to_pylist()))
                yield [*part.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    return with_results(docs, run, "score double, predicted int")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}
