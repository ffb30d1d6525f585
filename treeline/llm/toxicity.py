"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct terms, hashed to 64 bits: words (A-Z
lower-cased, punctuation separates) and their beginnings of a few bytes. The score is the logistic of
``w0 + sum w_i + sum over pairs <v_i, v_j>``; the pair sum is taken in linear
time as half of |sum v_i|^2 - sum |v_i|^2. So two terms that are harmless
alone can weigh together, which additive weights can't express.

Training is numpy on the driver, on at most ``max_rows`` labelled documents of
``max_items`` terms together: those of the smallest hash of doc_id, so the
sample does not depend on how rows are laid out. Every term in ``min_df``
training documents or more is learned; none is screened out by its own link to
the label. Weights come first: a term weighs once its summed errors pass what
chance makes of its frequency. The factors then start from the leading
eigenvectors of the terms' co-occurrence, weighted by what the weights leave
unexplained, which finds pairs whose terms say nothing alone; then all are
descended together. How long each goes on, how many terms a factor has and how
strong it starts is decided on a fifth of the training rows, and the machine is
then fitted to all of them. Terms that end up without a weight or factor aren't
kept, so the model has at most max_items / min_df terms.

The model goes to the workers as sorted arrays; scoring looks up
whole blocks of terms with one binary search. Every text is scored whole.

Defined cases: null, empty and unknown-term texts get the score of the bias
alone. Rows without a label (null toxic) aren't trained on; a null doc_id is
scored, with held_out false. With no labelled row, or one class only, the
score is the smoothed rate of the class, 0.5 without any label. Repeated rows
are scored each, and trained on each, within max_rows. Very long texts count
with all their terms; a labelled one that alone has more than max_items isn't
trained on. Labels of equal hash go by doc_id and label. An empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import stored
from treeline.llm.shingles import PUNCTUATION, blocks, word_hashes


#: Bytes of the word beginnings that count as terms beside the words, for stems with many endings.
STEMS = (4, 5, 6)


def term_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Distinct term hashes of each text."""
    for _, raws in blocks(texts):
        words, at = word_hashes(raws, PUNCTUATION, STEMS)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(words[a:b])


@dataclass
class FactorizationMachine:
    """terms: sorted hashes; weights, factors: a row for each; bias."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def raw(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-odds of documents whose term hashes lie in ``hashes`` between ``offsets``."""
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        if not len(self.terms) or not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashes)
        doc = np.searchsorted(offsets, hit, side="right") - 1
        at = at[hit]
        out += np.bincount(doc, self.weights[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def score(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(hashes, offsets), -50, 50)))

    @classmethod
    def fit(cls, sets: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 8, rate: float = 0.5, l1: float = 4.0, l2: float = 1.0, min_df: int = 5, batch: int = 16, seed: int = 7) -> FactorizationMachine:
        """l1: how many standard errors of chance a term's summed errors must pass before it weighs; l2 and rate of the weights' steps."""
        labels = np.asarray(labels, dtype=np.float64)
        share = (labels.sum() + 1) / (len(labels) + 2)
        prior = float(np.log(share / (1 - share)))
        none = np.empty(0, np.uint64)
        if not len(labels) or labels.min() == labels.max():
            return cls(none, np.empty(0), np.empty((0, factors)), prior)
        terms, df = np.unique(np.concatenate([*sets, none]), return_counts=True)
        terms = terms[df >= min_df]
        if not len(terms):
            return cls(none, np.empty(0), np.empty((0, factors)), prior)
        docs = []
        for s in sets:
            at = np.minimum(np.searchsorted(terms, s), len(terms) - 1)
            docs.append(at[terms[at] == s].astype(np.int32))
        check = np.random.default_rng(seed).random(len(docs)) < 0.2
        made = lambda rows: _Descent(docs, labels, rows, len(terms), factors, prior, rate, l1, l2, batch, seed)
        plan = epochs, 0, 0.0, 0
        if all(0 < labels[x].sum() < x.sum() for x in (check, ~check)):
            plan = made(np.flatnonzero(~check)).plan(_rows(docs, np.flatnonzero(check)), labels[check], epochs)
        whole = made(np.arange(len(docs)))
        whole.follow(plan)
        used = (whole.w != 0) | (whole.v != 0).any(1)
        return cls(terms[used], whole.w[used], whole.v[used], float(whole.b))


def _rows(docs: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, document of each, counted from 0) of some documents."""
    sizes = [len(docs[r]) for r in rows]
    return np.concatenate([*(docs[r] for r in rows), np.empty(0, np.int32)]), np.repeat(np.arange(len(rows)), sizes)


class _Descent:
    """Descent of the logistic loss on some of the documents.

    Weights follow the regularised leader: z is a term's sum of errors, and it
    weighs nothing until that passes l1 times what chance makes of a term of its
    frequency, so the many terms without a say stay out of the sum.
    """

    SIZES, STRENGTHS = (16, 64, 256, 1024), (0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
    #: What the terms beyond a factor's largest keep of theirs.
    REST = 0.01

    def __init__(self, docs: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, n_terms: int, factors: int, prior: float, rate: float, l1: float, l2: float, batch: int, seed: int):
        self.docs, self.labels, self.rows, self.rate, self.l2, self.batch = docs, labels, rows, rate, l2, batch
        self.factors, self.seed = factors, seed
        self.rng = np.random.default_rng(seed)
        share = labels.mean()
        self.df = np.bincount(_rows(docs, rows)[0], minlength=n_terms)
        self.l1 = l1 * np.sqrt(self.df * share * (1 - share))
        self.z, self.n = np.zeros(n_terms), np.zeros(n_terms)
        self.w, self.v, self.b = np.zeros(n_terms), np.zeros((n_terms, factors)), prior
        self.gv, self.gb = np.ones((n_terms, factors)), 1.0

    def raw(self, at: np.ndarray, doc: np.ndarray, n: int, v: np.ndarray | None = None) -> np.ndarray:
        out = self.b + np.bincount(doc, self.w[at], n)
        v = self.v if v is None else v
        if v.any():
            some = v.any(1)[at]
            at, doc = at[some], doc[some]
            for f in v.T:
                x = f[at]
                out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def epoch(self) -> None:
        order = self.rng.permutation(self.rows)
        paired = self.v.any(1)
        for a in range(0, len(order), self.batch):
            rows = order[a : a + self.batch]
            at, doc = _rows(self.docs, rows)
            n = len(rows)
            used, back = np.unique(at, return_inverse=True)
            err = 1 / (1 + np.exp(-np.clip(self.raw(at, doc, n), -50, 50))) - self.labels[rows]
            if paired[used].any():
                some = paired[at]
                t, d = at[some], doc[some]
                mine, place = np.unique(t, return_inverse=True)
                for f in range(self.factors):
                    x = self.v[t, f]
                    dv = np.bincount(place, err[d] * (np.bincount(d, x, n)[d] - x), len(mine))
                    self.gv[mine, f] += dv * dv
                    self.v[mine, f] -= 0.1 * self.rate * dv / np.sqrt(self.gv[mine, f])
            g = np.bincount(back, err[doc], len(used))
            grown = np.sqrt(self.n[used] + g * g)
            self.z[used] += g - (grown - np.sqrt(self.n[used])) / self.rate * self.w[used]
            self.n[used] += g * g
            z = self.z[used]
            self.w[used] = np.where(np.abs(z) <= self.l1[used], 0.0, -(z - np.sign(z) * self.l1[used]) / ((1 + grown) / self.rate + self.l2))
            self.gb += err.sum() ** 2
            self.b -= 0.1 * err.sum() / np.sqrt(self.gb)

    def leading(self, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, values): what pairs the weights leave unexplained.

        Leading eigenvectors of the sum over documents of error times x x', without
        its diagonal, by subspace iteration; terms are scaled by their frequency to
        the power of -1/4, so that neither the commonest nor the rarest rule. Only
        likings (values above zero) can be factors of a square.
        """
        at, doc = _rows(self.docs, self.rows)
        n, width = len(self.rows), len(self.w)
        error = self.labels[self.rows] - 1 / (1 + np.exp(-np.clip(self.raw(at, doc, n), -50, 50)))
        scale = np.maximum(self.df, 1.0) ** -0.25
        own = np.bincount(at, error[doc], width) * scale**2

        def times(q: np.ndarray) -> np.ndarray:
            out = np.empty_like(q)
            for j in range(q.shape[1]):
                along = np.bincount(doc, (q[:, j] * scale)[at], n) * error
                out[:, j] = np.bincount(at, along[doc], width) * scale - own * q[:, j]
            return out

        q = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(width, min(width, self.factors + 4))))[0]
        for _ in range(rounds):
            q = np.linalg.qr(times(q))[0]
        values, inner = np.linalg.eigh(q.T @ times(q))
        order = [i for i in np.argsort(-values)[: self.factors] if values[i] > 0]
        return (q @ inner[:, order]) * scale[:, None], values[order]

    def factors_of(self, size: int, strength: float, lead: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Factors from the leading vectors, the largest of the first as long as ``strength``: all terms have theirs, those beyond the ``size`` largest shrunk."""
        out = np.zeros_like(self.v)
        vectors, values = lead
        for j in range(vectors.shape[1]):
            top = np.argsort(-np.abs(vectors[:, j]), kind="stable")[:size]
            out[:, j] = self.REST * vectors[:, j]
            out[top, j] = vectors[top, j]
            out[:, j] *= strength * np.sqrt(values[j] / values[0]) / np.abs(vectors[top, j]).max()
        return out

    def loss(self, held: tuple[np.ndarray, np.ndarray], labels: np.ndarray, v: np.ndarray | None = None) -> float:
        raw = np.clip(self.raw(*held, len(labels), v), -50, 50)
        return float(np.logaddexp(0, raw).mean() - (raw * labels).mean())

    def plan(self, held: tuple[np.ndarray, np.ndarray], labels: np.ndarray, epochs: int) -> tuple[int, int, float, int]:
        """(epochs of weights alone, terms and strength of the factors, epochs of all) that do best on held documents."""
        state = lambda: [x.copy() for x in (self.w, self.z, self.n)] + [self.b, self.gb]
        best, first, kept = self.loss(held, labels), 0, state()
        for e in range(1, epochs + 1):
            self.epoch()
            if (now := self.loss(held, labels)) < best:
                best, first, kept = now, e, state()
        self.w, self.z, self.n, self.b, self.gb = kept
        if not self.factors:
            return first, 0, 0.0, 0
        lead = self.leading()
        if not lead[0].shape[1]:  # no two terms are seen together more than alone
            return first, 0, 0.0, 0
        sizes = sorted({min(m, len(self.w)) for m in (*self.SIZES, len(self.w))})
        # Where factors help little they are weak, not absent.
        best, size, strength = min((self.loss(held, labels, self.factors_of(m, c, lead)), m, c) for m in sizes for c in self.STRENGTHS)
        self.v, then = self.factors_of(size, strength, lead), 0
        for e in range(1, epochs + 1):
            self.epoch()
            if (now := self.loss(held, labels)) < best:
                best, then = now, e
        return first, size, strength, then

    def follow(self, plan: tuple[int, int, float, int]) -> None:
        first, size, strength, then = plan
        for _ in range(first):
            self.epoch()
        if size:
            self.v = self.factors_of(size, strength, self.leading())
            for _ in range(then):
                self.epoch()


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int) -> list:
    """At most max_rows rows (doc_id, text, label) of those that may be trained on, by the smallest hash of doc_id."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(train).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id")
    return rows


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [s.tobytes() for s in term_sets(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), part.column(2)], ["doc_id", "terms", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", may: Column | None = None, max_rows: int = 6000, max_items: int = 12_000_000, **fit) -> FactorizationMachine:
    """A machine from at most max_rows labelled documents with max_items distinct terms together; ``may`` says which doc_ids may be learned from."""
    rows = labelled(docs, labels, label, F.lit(True) if may is None else may, max_rows)
    made = stored(rows.mapInArrow(_terms, "doc_id long, terms binary, label int"))
    # Repeated doc_ids can be more rows than labels: bounded again, before anything goes to the driver.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.xxhash64("terms")]
    some = made.select("doc_id", "label", F.length("terms").alias("size"), *[o.alias(f"o{i}") for i, o in enumerate(order)]).orderBy("o0", "o1", "o2", "o3").limit(max_rows)
    total = F.sum("size").over(Window.orderBy("o0", "o1", "o2", "o3").rowsBetween(Window.unboundedPreceding, 0))
    fits = some.withColumn("total", total).where(F.col("total") <= 8 * max_items).select("o0", "o1", "o2", "o3").distinct()
    picked = made.withColumns({f"o{i}": o for i, o in enumerate(order)}).join(F.broadcast(fits), ["o0", "o1", "o2", "o3"], "left_semi")
    got = picked.select("doc_id", "terms", "label", "o3").orderBy("doc_id", "label", "o3").limit(max_rows).toArrow()
    sets = [np.frombuffer(x, np.uint64) for x in got.column("terms").to_pylist()]
    return FactorizationMachine.fit(sets, got.column("label").to_numpy(), **fit)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_items / min_df terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = list(term_sets(part.column(1).to_pylist()))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                scores = model.score(np.concatenate([*sets, np.empty(0, np.uint64)]), offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
