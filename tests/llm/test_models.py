"""Toxicity and quality: held-out accuracy, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from treeline.llm import quality, toxicity
from treeline.llm.toxicity import FactorizationMachine

SF = "/root/testdata/sf0.1"


def exclusive_pairs(noise, per):
    """Documents of label 1 if just one of two terms is there, among others that say nothing."""
    rng = np.random.default_rng(1)
    sets, labels = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        sets.append(np.unique(np.array([10 + a, 20 + b, *(100 + rng.integers(0, noise, per))], np.uint64)))
        labels.append(int(a != b))
    return sets, np.array(labels)


def flat(sets):
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


@pytest.mark.parametrize(("noise", "per"), [(30, 1), (3000, 30)])
def test_machine_learns_pairs_that_add_up_to_nothing(noise, per):
    sets, labels = exclusive_pairs(noise, per)
    right = lambda **fit: ((FactorizationMachine.fit(sets[:2000], labels[:2000], **fit).score(*flat(sets[2000:])) >= 0.5) == labels[2000:]).mean()
    assert right() > 0.97
    assert right(factors=0) < 0.6


def test_pairs_do_no_harm_to_held_out_documents():
    import zlib

    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    rows = docs.merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id").dropna(subset=["toxic"])
    sets, labels = list(toxicity.term_sets(rows.text.tolist())), rows.toxic.to_numpy().astype(int)
    held = np.array([zlib.crc32(str(x).encode()) % 5 == 0 for x in rows.doc_id])
    right = lambda n: ((FactorizationMachine.fit([s for s, h in zip(sets, held, strict=True) if not h], labels[~held], factors=n).score(*flat([s for s, h in zip(sets, held, strict=True) if h])) >= 0.5) == labels[held]).mean()
    assert right(4) > right(0) > 0.98


def test_pair_sum_equals_the_double_loop():
    rng = np.random.default_rng(2)
    m = FactorizationMachine(np.arange(5, dtype=np.uint64), rng.normal(size=5), rng.normal(size=(5, 3)), 0.25)
    want = 0.25 + m.weights[[0, 2, 4]].sum() + sum(m.factors[i] @ m.factors[j] for i, j in [(0, 2), (0, 4), (2, 4)])
    assert np.isclose(m.raw(np.array([0, 2, 4, 9], np.uint64), np.array([0, 4]))[0], want)


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.BoostedTrees.fit(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95

    def walk(row):
        total = model.prior
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return total

    assert np.allclose(model.raw(x[:50]), [walk(r) for r in x[:50]])


def test_features_do_not_depend_on_the_block():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Aa", "b.", "c|", "9"]) for _ in range(rng.randint(0, 40))) + "\nx" * rng.randint(0, 3) for _ in range(50)] + ["", None, " ", "é"]
    whole = quality.features(texts)
    assert np.allclose(whole, np.concatenate([quality.features([t]) for t in texts]))
    assert not whole[50].any() and not whole[51].any()


@pytest.mark.parametrize(("op", "name", "label", "mod", "out", "threshold"), [(toxicity, "op9_toxicity", "toxic", 5, 0, 0.5), (quality, "op10_quality", "quality", 4, 2, 0.7)])
def test_held_out_accuracy(spark, op, name, label, mod, out, threshold):
    import zlib

    got = {r["doc_id"]: r for r in op.QUERIES[name](spark, SF).collect()}
    marks = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % mod == out) and r["predicted"] == (r["score"] >= threshold) for d, r in got.items())
    held = [(got[d]["predicted"], y) for d, y in marks.items() if got[d]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_no_labels_one_class_and_odd_texts(spark, op, label):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "x y"), (4, "w " * 50_000)], "doc_id long, text string")
    for rows in ([], [(1, 1, 1)], [(1, None, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        scores = {r["score"] for r in op.score(docs, op.train(docs, labels, label)).collect()}
        assert len(scores) == 1 and (rows == [(1, 1, 1)]) == (scores != {0.5})


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_repeated_rows_clashing_columns_and_empty_tables(spark, op, label):
    docs = spark.createDataFrame([(i % 40, "good words" if i % 2 else "bad words", 0.5, 7) for i in range(80)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = op.train(docs, labels, label)
    got = op.score(docs, model)
    assert got.columns.count("score") == 1 and len({tuple(r) for r in got.select("doc_id", "score", "predicted").collect()}) == 40 and got.count() == 80
    assert op.score(docs.limit(0), model).collect() == []
    assert op.train(docs.limit(0), labels, label).score is not None
    assert op.train(docs, labels, label, max_rows=10).score is not None


def test_training_texts_are_bounded_by_their_terms(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50)) if i else "v " * 3) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels, max_items=1, min_df=1).terms) == 0


def test_factors_of_all_terms_are_shrunk_not_dropped():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 400)
    # One word says it all, so factors have next to nothing to add.
    sets = [np.unique(np.r_[np.uint64(1 + y), rng.integers(10, 60, 20).astype(np.uint64)]) for y in labels]
    model = toxicity.FactorizationMachine.fit(sets, labels)
    assert len(model.terms) == len(np.unique(np.concatenate(sets))) and (model.factors != 0).any(1).all()
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    assert ((model.score(flat, at) >= 0.5) == labels).mean() > 0.98
