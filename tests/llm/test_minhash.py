from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import minhash
from treeline.llm.common import components, find, join_roots
from treeline.llm.minhash import near_duplicates
from treeline.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string"


def brute(rows, k, percent):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return set()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)], least[find(i)] == doc) for i, (doc, _) in enumerate(rows))


def got(spark, rows, **kw):
    return sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((doc, rng.choice([" ", "\n", "\t "]).join(words)))
            doc += 1
    rows += [(doc, ""), (doc + 1, None), (doc + 2, "one"), (doc + 3, "ONE"), (doc + 4, " \t"), (doc + 5, " x y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    rows = corpus(k)
    assert got(spark, rows, k=k) == brute(rows, k, 80)


def test_small_blocks_give_the_same(spark):
    rows = corpus(9)
    assert got(spark, rows, k=2, window=2, block_items=150) == brute(rows, 2, 80)


@pytest.mark.parametrize(("window", "block_items"), [(4, 300), (512, 300), (4, 1_000_000)])
def test_crowds_lose_no_link(spark, window, block_items):
    # Each satellite is near one of eighty near copies only, just over the threshold.
    rng = random.Random(4)
    core = [f"c{i}" for i in range(190)]
    rows = []
    for i in range(80):
        own = [f"u{i}x{j}" for j in range(10)]
        rows.append((i, " ".join(core + own)))
        rows.append((1000 + i, " ".join(rng.sample(core, 168) + own + [f"j{i}x{j}" for j in range(22)])))
    want = brute(rows, 1, 80)
    assert {c for _, _, c, _ in want} == {0}
    assert got(spark, rows, k=1, window=window, block_items=block_items) == want


def test_parts_of_a_large_coarse_component(spark):
    # Chains: each text is near the next only, and no block holds a chain.
    rng = random.Random(6)
    rows = []
    for c in range(4):
        words = [f"v{c}x{i}" for i in range(60)]
        for i in range(25):
            words = words[3:] + [f"v{c}x{60 + 3 * i + j}" for j in range(3)]
            rows.append((100 * c + i, " ".join(words)))
    rng.shuffle(rows)
    want = brute(rows, 1, 80)
    assert {c for _, _, c, _ in want} == {0, 100, 200, 300}
    assert got(spark, rows, k=1, block_items=200) == want


def test_neighbours_stream_like_one_batch():
    # Windows and batches of any size find the same as one comparison of each small region.
    rng = np.random.default_rng(3)
    regions, sigs = [], []
    for r in range(60):
        base = rng.integers(0, 2**16, 128)
        for _ in range(rng.integers(1, 9)):
            own = np.where(rng.random(128) < rng.choice([0.05, 0.6]), rng.integers(0, 2**16, 128), base)
            regions.append(r)
            sigs.append(own.astype(np.uint16))
    ids = np.arange(len(regions))

    def found(size, window):
        parts = [pa.RecordBatch.from_arrays([pa.array(regions[a : a + size], pa.int64()), pa.array(ids[a : a + size]), pa.array([s.tobytes() for s in sigs[a : a + size]], pa.binary())], ["region", "rep", "sig"]) for a in range(0, len(ids), size)]
        parent: dict = {}
        for batch in minhash._neighbours(80, window)(iter(parts)):
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                join_roots(parent, a, b)
        return {x: find(parent, x) for x in list(parent)}

    want = found(1000, 16)
    assert want and all(found(size, 16) == want for size in (1, 2, 3, 7, 50))


@pytest.mark.parametrize("depth", [3, 5, 8])
def test_recall_of_the_orders(depth):
    # Share of pairs at similarity 0.8 that share a prefix of so many values in one of the orders.
    rng = np.random.default_rng(depth)
    hit = 0
    for _ in range(200):
        both = rng.integers(1, 2**63, 400, dtype=np.uint64)
        a, b = (minhash.signature(np.concatenate([both, rng.integers(1, 2**63, 50, dtype=np.uint64)])).reshape(minhash.TREES, minhash.LEVELS) for _ in range(2))
        hit += (a[:, :depth] == b[:, :depth]).all(1).any()
    assert hit >= 200 * {3: 0.999, 5: 0.97, 8: 0.9}[depth]


def test_null_ids_repeated_rows_and_empty_table(spark):
    out = near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], SCHEMA), k=2)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns_and_a_very_long_text(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, 5, "q"), (2, long + " tail", 6, "q")], "doc_id long, text string, component_id int, sig string")
    assert sorted(tuple(r) for r in near_duplicates(df, k=5).collect()) == [(1, 59_996, 1, True), (2, 59_997, 1, False)]


def test_shingle_hashes_count_like_strings():
    texts = ["a b a b a", "A  b\x0bc", "é è é", "", None, "x"]
    assert [len(s) for s in shingle_sets(texts, 2)] == [2, 2, 2, 0, 0, 1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_chains_in_any_order(spark):
    n = 300
    shuffled = random.Random(3).sample(range(n), n)
    chains = [[0, *range(n - 1, 0, -1)], [1000 + x for x in shuffled], [2000 + x for x in range(n)]]
    edges = spark.createDataFrame([e for c in chains for e in zip(c[:-1], c[1:], strict=True)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {x: min(c) for c in chains for x in c}
